"""A small packrat engine for parsing-expression grammars.

A grammar is a text of rules ``Name <- expression``. Expressions: sequence, ordered choice ``/``,
``*``, ``+``, ``?``, ``&`` and ``!`` predicates, groups, rule names, and terminals:

* ``'text'``    the text itself, then trivia (blanks and comments) is skipped,
* ``"word"``    the same for a keyword, which must end at a word boundary,
* ``⟨regex⟩``   a regular expression, then trivia is skipped,
* ``⟦regex⟧``   a regular expression alone,
* ``n=Rule`` and ``@n``  remember what a rule matched, and match the same text again,
* ``^name``     a predicate given as a Python function of (text, position).

The rules are compiled to Python functions that map a position to the end of the match or -1. Every
rule remembers its result at each position, which makes the parse linear in the text; a rule that is a single
terminal is written out where it is used. Calls nest as deep as the text does: they lie on the heap, so only
memory bounds them (about half a kilobyte a call). The input must
be consumed in full. Only when it is not, the parse is repeated with a second set of functions that
also record the furthest position at which a terminal failed.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_LEX = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<rule>[A-Za-z]\w*)\s*<-
    |(?P<raw>⟦[^⟧]*⟧)
    |(?P<re>⟨[^⟩]*⟩)
    |(?P<lit>'(?:[^'\\]|\\.)+')
    |(?P<kw>"\w+")
    |(?P<cap>[a-z]\w*)=
    |@(?P<same>[a-z]\w*)
    |\^(?P<call>\w+)
    |(?P<name>[A-Za-z]\w*)
    |(?P<op>[/*+?&!()])""",
    re.X,
)


def _tokens(grammar: str):
    at = 0
    while at < len(grammar):
        m = _LEX.match(grammar, at)
        if not m:
            raise ValueError(f"grammar error near {grammar[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m.group(m.lastgroup)


def read_grammar(grammar: str) -> dict[str, tuple]:
    """Rule name -> expression; a rule that is defined again replaces the earlier one."""
    tokens = [*_tokens(grammar), ("end", "")]
    rules: dict[str, tuple] = {}
    at = 0

    def choice() -> tuple:
        nonlocal at
        items = [sequence()]
        while tokens[at] == ("op", "/"):
            at += 1
            items.append(sequence())
        return items[0] if len(items) == 1 else ("alt", items)

    def sequence() -> tuple:
        items = []
        while tokens[at][0] not in ("rule", "end") and tokens[at] not in (("op", "/"), ("op", ")")):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefixed() -> tuple:
        nonlocal at
        kind, value = tokens[at]
        if kind == "op" and value in "&!":
            at += 1
            return ("and" if value == "&" else "not", prefixed())
        if kind == "cap":
            at += 1
            return ("cap", value, suffixed())
        return suffixed()

    def suffixed() -> tuple:
        nonlocal at
        node = primary()
        while tokens[at][0] == "op" and tokens[at][1] in "*+?":
            node = ({"*": "star", "+": "plus", "?": "opt"}[tokens[at][1]], node)
            at += 1
        return node

    def primary() -> tuple:
        nonlocal at
        kind, value = tokens[at]
        at += 1
        if (kind, value) == ("op", "("):
            node = choice()
            if tokens[at] != ("op", ")"):
                raise ValueError("unbalanced group")
            at += 1
            return node
        if kind == "lit":
            return ("re", re.escape(value[1:-1].replace("\\'", "'").replace("\\\\", "\\")), True)
        if kind == "kw":
            return ("re", value[1:-1] + r"(?![\w$])", True)
        if kind == "re":
            return ("re", value[1:-1], True)
        if kind == "raw":
            return ("re", value[1:-1], False)
        if kind in ("same", "call"):
            return (kind, value)
        if kind == "name":
            return ("ref", value)
        raise ValueError(f"unexpected {value!r}")

    while tokens[at][0] == "rule":
        name = tokens[at][1]
        at += 1
        rules[name] = choice()
    if tokens[at][0] != "end":
        raise ValueError(f"unexpected {tokens[at][1]!r}")
    return rules


class _Writer:
    """Writes the Python functions of a grammar."""

    def __init__(self, trivia: str, track: bool, rules: dict[str, tuple]):
        self.trivia, self.track, self.rules = trivia, track, rules
        self.lines: list[str] = []
        self.patterns: dict[str, str] = {}
        self.n = 0

    def put(self, depth: int, line: str) -> None:
        self.lines.append(" " * depth + line)

    def fresh(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def node(self, node: tuple, i: str, depth: int) -> str:
        """Code that matches the node at ``i``; gives the name of the variable with the result."""
        kind = node[0]
        if kind == "seq":
            out, last, d = self.fresh(), i, depth
            self.put(depth, f"{out} = -1")
            for n, item in enumerate(node[1]):
                last = self.node(item, last, d)
                if n < len(node[1]) - 1:
                    self.put(d, f"if {last} >= 0:")
                    d += 1
            self.put(d, f"{out} = {last}")
            return out
        if kind == "alt":
            out, d = self.fresh(), depth
            for item in node[1]:
                got = self.node(item, i, d)
                self.put(d, f"{out} = {got}")
                self.put(d, f"if {out} < 0:")
                d += 1
            self.put(d, "pass")
            return out
        if kind in ("star", "plus"):
            out = self.fresh()
            if kind == "plus":
                first = self.node(node[1], i, depth)
                self.put(depth, f"{out} = {first}")
                self.put(depth, f"while {out} >= 0:")
            else:
                self.put(depth, f"{out} = {i}")
                self.put(depth, "while True:")
            got = self.node(node[1], out, depth + 1)
            self.put(depth + 1, f"if {got} <= {out}: break")
            self.put(depth + 1, f"{out} = {got}")
            return out
        if kind == "opt":
            out = self.fresh()
            got = self.node(node[1], i, depth)
            self.put(depth, f"{out} = {got} if {got} >= 0 else {i}")
            return out
        if kind in ("and", "not"):
            out = self.fresh()
            got = self.node(node[1], i, depth)
            test = ">=" if kind == "and" else "<"
            self.put(depth, f"{out} = {i} if {got} {test} 0 else -1")
            return out
        if kind == "ref" and self.rules[node[1]][0] == "re":
            return self.node(self.rules[node[1]], i, depth)
        if kind == "ref":
            out = self.fresh()
            self.put(depth, f"{out} = r_{node[1]}({i})")
            return out
        if kind == "cap":
            got = self.node(node[2], i, depth)
            self.put(depth, f"c_{node[1]} = G['T'][{i}:{got}] if {got} >= 0 else ''")
            return got
        if kind == "same":
            out = self.fresh()
            self.put(depth, f"{out} = {i} + len(c_{node[1]}) if G['T'].startswith(c_{node[1]}, {i}) else -1")
            return out
        if kind == "call":
            out = self.fresh()
            self.put(depth, f"{out} = {i} if H_{node[1]}(G['T'], {i}) else -1")
            return out
        _, pattern, skip = node
        full = f"(?:{pattern}){self.trivia}" if skip else pattern
        name = self.patterns.setdefault(full, f"P{len(self.patterns)}")
        out = self.fresh()
        self.put(depth, f"{out} = {name}(G['T'], {i})")
        fail = f"F({i})" if self.track else "-1"
        self.put(depth, f"{out} = {out}.end() if {out} else {fail}")
        return out


class Grammar:
    """A compiled grammar; ``parse`` gives (ok, furthest failure position).

    ``start`` is the rule for the whole text. With ``items`` the text is a sequence of that rule, and what
    is remembered of an item is forgotten behind it, so that memory follows the largest item.
    """

    def __init__(self, text: str, start: str, trivia: str = r"\s*+", hooks: dict[str, Callable] | None = None, items: bool = False):
        self.rules, self.start, self.items = read_grammar(text), start, items
        self.skip = re.compile(trivia).match
        hooks = hooks or {}
        self._fast, self._slow = (self._build(trivia, track, hooks) for track in (False, True))

    def _build(self, trivia: str, track: bool, hooks: dict[str, Callable]) -> dict:
        writer = _Writer(trivia, track, self.rules)
        for name, node in self.rules.items():
            writer.put(0, f"def r_{name}(i):")
            writer.put(1, f"o = M_{name}.get(i)")
            writer.put(1, "if o is not None: return o")
            out = writer.node(node, "i", 1)
            writer.put(1, f"M_{name}[i] = {out}")
            writer.put(1, f"return {out}")
        space: dict = {"G": {"T": "", "far": 0}}
        space |= {f"H_{name}": hook for name, hook in hooks.items()}
        space |= {f"M_{name}": {} for name in self.rules}
        space |= {name: re.compile(pattern).match for pattern, name in writer.patterns.items()}

        def failed(i: int) -> int:
            if i > space["G"]["far"]:
                space["G"]["far"] = i
            return -1

        space["F"] = failed
        exec(compile("\n".join(writer.lines), "<grammar>", "exec"), space)  # noqa: S102
        return space

    def _run(self, space: dict, text: str, at: int) -> int:
        space["G"]["T"], space["G"]["far"] = text, at
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(old, min(len(self.rules) * (len(text) + 2), (1 << 31) - 1)))
        rule, memories = space[f"r_{self.start}"], [space[f"M_{name}"] for name in self.rules]
        try:
            if not self.items:
                return rule(at)
            while True:
                end = rule(at)
                if end <= at:
                    return at
                at = end
                for memory in memories:
                    memory.clear()
        finally:
            sys.setrecursionlimit(old)
            for memory in memories:
                memory.clear()

    def accepts(self, text: str, at: int = 0) -> bool:
        """Whether the start rule consumes the text from ``at`` to its end."""
        return self._run(self._fast, text, self.skip(text, at).end()) == len(text)

    def parse(self, text: str, at: int = 0) -> tuple[bool, int]:
        """Whether the start rule consumes the text from ``at`` to its end, and how far it came."""
        if self.accepts(text, at):
            return True, len(text)
        end = self._run(self._slow, text, self.skip(text, at).end())
        return False, max(end, self._slow["G"]["far"])
