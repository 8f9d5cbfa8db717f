"""Part of sieveline."""
