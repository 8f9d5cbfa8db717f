"""The public calls as methods over DataFrames: capsules, symbol and evidence reading, edit planning, capped reports.

Inputs are checked here; everything else is the operators'. Many tasks, symbols or references are
answered by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import capsule as K
from sieveline.operators import evidence as E
from sieveline.operators import index as I
from sieveline.operators import patch as M
from sieveline.operators import ranking as R
from sieveline.session import checkpointed

LONGEST_TASK, LONGEST_SYMBOL = 20_000, 1_024


def whole(name: str, value: object, low: int, high: int) -> int:
    """A whole number between two bounds, or a RangeError's Python kin."""
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer between {low} and {high}")
    return value


class Toolbox:
    """``files(file_id, project, relative, text)`` indexed once; each method answers a whole table of requests."""

    def __init__(self, files: DataFrame, aliases: DataFrame | None = None):
        self.files = files
        self.symbols = checkpointed(I.symbols(files))
        self.tokens = checkpointed(I.fields(self.symbols))
        self.imports = checkpointed(I.resolved_imports(files, aliases))

    def context_capsules(
        self, requests: DataFrame, level: int = 1, tokens: int | None = None, attempt: int = 0, most_attempts: int = 3
    ) -> DataFrame:
        """requests(task_id, project, task) -> one capsule each; blank and overlong tasks are refused.

        The project may be left out where the files have only one.
        """
        whole("level", level, 0, 3)
        whole("attempt", attempt, 0, 10)
        whole("most_attempts", most_attempts, 1, 10)
        if tokens is not None:
            whole("tokens", tokens, 200, 1200)
        bad = requests.where(F.coalesce(F.trim("task"), F.lit("")) == "").limit(1).count() or requests.where(F.length("task") > LONGEST_TASK).limit(1).count()
        if bad:
            raise ValueError(f"tasks must be non-empty and of at most {LONGEST_TASK} characters")
        if "project" not in requests.columns:
            projects = [r["project"] for r in self.files.select("project").distinct().limit(2).collect()]
            if len(projects) > 1:
                raise ValueError("requests must name the project, as the files have several")
            requests = requests.withColumn("project", F.lit(projects[0] if projects else None).cast("string"))
        found = checkpointed(R.tasks(requests, "task_id", "task"))
        stats, df = checkpointed(I.corpus_stats(self.tokens)), checkpointed(I.doc_freq(self.tokens))
        ranked = checkpointed(R.rank(R.scores(found, self.symbols, self.tokens, df, stats), self.symbols))
        handoff = attempt >= most_attempts
        chosen = K.levels(R.confidence(ranked, found, self.tokens), found, level, handoff)
        if tokens is not None:
            chosen = chosen.withColumn("tokens", F.lit(tokens))
        chosen = checkpointed(chosen)
        direct = checkpointed(K.direct_symbols(R.promote(ranked, found, self.imports), chosen))
        back = self.imports.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = checkpointed(self.imports.unionByName(back).unionByName(I.call_edges(self.files, self.symbols)).distinct())
        near = direct.select("project", F.col("file").alias("src")).distinct().join(edges, ["project", "src"])
        some = near.select("project", F.col("dst").alias("file")).distinct().join(self.symbols, ["project", "file"])
        scored = R.scores(found, self.symbols, self.tokens, df, stats, some)
        beside = K.neighbours(direct, chosen, self.symbols, scored, edges, I.callees(self.files))
        packed = K.pack(found, chosen, K.references(direct, beside, self.symbols))
        reported = F.when(F.col("confidence") < K.LOW_CONFIDENCE, 3).otherwise(F.col("level"))
        return packed.withColumn("reported_level", reported).withColumn("handoff_required", F.lit(handoff))

    def read_symbols(self, names: DataFrame, max_tokens: int = 1200) -> DataFrame:
        """names(project, name) -> up to eight matches each; the text only where the name is unambiguous."""
        whole("max_tokens", max_tokens, 1, 4000)
        found = E.lookup(self.symbols, names.where(F.length("name") <= LONGEST_SYMBOL))
        return found.withColumn("source", F.substring("source", 1, max_tokens * 4))

    def read_evidence(self, records: DataFrame, max_tokens: int = 1200, known: DataFrame | None = None) -> DataFrame:
        """Pages of evidence records; records whose reference is ``known(ref)`` give one empty, unchanged page."""
        whole("max_tokens", max_tokens, 300, 4000)
        referred = E.references(records)
        paged = E.pages(referred, max_tokens).join(referred.select("evidence_id", "ref"), "evidence_id").withColumn("unchanged", F.lit(False))
        if known is None:
            return paged
        same = paged.join(known.select("ref").distinct(), "ref", "left_semi").where("page = 0")
        marker = same.withColumn("source", F.lit("")).withColumn("next_offset", F.lit(None).cast("int")).withColumn("done", F.lit(True))
        fresh = paged.join(known.select("ref").distinct(), "ref", "left_anti")
        return fresh.unionByName(marker.withColumn("unchanged", F.lit(True)).select(fresh.columns))

    def plan_edits(self, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(plan per file, patched texts of the files whose whole batch can be applied)."""
        resolved = checkpointed(M.resolve(operations, self.symbols, self.files))
        return M.plan(resolved), M.splice(resolved, self.files)

    def rollback_states(self, journal: DataFrame) -> DataFrame:
        """journal(file_id, original_hash, patched_hash) -> patched, original or foreign; writing is the caller's."""
        return M.rollback_states(self.files, journal)

    def capped_diagnostics(self, messages: DataFrame, budget: int = 300) -> DataFrame:
        """messages(file_id, ord, text): the leading messages of each file within the token budget."""
        return M.capped_prefix(messages, ["file_id"], "ord", "text", whole("budget", budget, 1, 100_000))
