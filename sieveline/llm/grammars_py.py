"""Grammar of Python 3.13, with the lexical pass that makes its layout explicit, and of JSON.

The lexical pass joins continued lines, drops comments and blank lines and writes the layout as
control characters, so that the grammar proper can be a parsing-expression grammar over text. The
literal text of formatted strings is dropped, their replacement fields are kept for the grammar.
"""

from __future__ import annotations

import bisect
import re

NEWLINE, INDENT, DEDENT, FORMAT, FORMAT_END = "\x01", "\x02", "\x03", "\x05", "\x06"

_STRING = (
    r"(?:[uUbB]|[bB][rR]|[rR][bB]?)?(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\""
    r"|'(?!'')(?:[^\\'\r\n]|\\(?:\r\n|[\s\S]))*+'|\"(?!\"\")(?:[^\\\"\r\n]|\\(?:\r\n|[\s\S]))*+\")"
)
_TOKEN = re.compile(
    rf"""(?P<blank>[ \t\f]+|\\(?:\r\n|\r|\n))
    |(?P<comment>\#[^\r\n]*)
    |(?P<newline>\r\n|\r|\n)
    |(?P<format>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))
    |(?P<string>{_STRING})
    |(?P<quote>['"])
    |(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+
       |(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?:(?=(?:and|or|if|in|is|else|for|not)\b)|(?!\w)))
    |(?P<name>[^\W\d]\w*)
    |(?P<open>[(\[{{])
    |(?P<close>[)\]}}])
    |(?P<op>\*\*=?|//=?|>>=?|<<=?|->|:=|!=|\.\.\.|[+\-*/%&|^@=<>]=|[+\-*/%&|^~@<>=,.:;])""",
    re.X,
)
_LEADING_ZERO = re.compile(r"0[0_]*[1-9][\d_]*$")
_PAIRS = {")": "(", "]": "[", "}": "{"}


class LayoutError(ValueError):
    """The text breaks a lexical rule at ``at``."""

    def __init__(self, at: int):
        super().__init__(str(at))
        self.at = at


class Layout:
    """The text with explicit layout; ``source(i)`` gives the place in the source of a place in it."""

    def __init__(self, text: str):
        self.text, self.out, self.size = text, [], 0
        self.places: list[int] = []
        self.origins: list[int] = []
        self._lines()
        self.result = "".join(self.out)

    def put(self, piece: str, at: int) -> None:
        self.out.append(piece)
        self.places.append(self.size)
        self.origins.append(at)
        self.size += len(piece)

    def source(self, at: int) -> int:
        k = bisect.bisect_right(self.places, at) - 1
        return self.origins[k] + at - self.places[k] if k >= 0 else at

    def _lines(self) -> None:
        text, at, indents = self.text, 0, [(0, 0)]
        while at < len(text):
            start, column, narrow = at, 0, 0
            while at < len(text) and text[at] in " \t\f":
                if text[at] == "\t":
                    column, narrow = column // 8 * 8 + 8, narrow + 1
                elif text[at] == "\f":
                    column = narrow = 0
                else:
                    column, narrow = column + 1, narrow + 1
                at += 1
            if at < len(text) and text[at] in "#\r\n":
                comment = re.compile(r"#[^\r\n]*").match(text, at)
                at = comment.end() if comment else at
                at += 2 if text.startswith("\r\n", at) else at < len(text)
                continue
            if at == len(text):
                break
            if column > indents[-1][0]:
                if narrow <= indents[-1][1]:
                    raise LayoutError(start)
                indents.append((column, narrow))
                self.put(INDENT, at)
            else:
                while column < indents[-1][0]:
                    indents.pop()
                    self.put(DEDENT, at)
                if (column, narrow) != indents[-1]:
                    raise LayoutError(at)
            at = self._tokens(at, None)
            self.put(NEWLINE, min(at, len(text)))
        for _ in indents[1:]:
            self.put(DEDENT, len(text))

    def _tokens(self, at: int, closing: str | None) -> int:
        """Tokens up to the end of the logical line, or in a replacement field up to its end."""
        text, open_at = self.text, []
        while at < len(text):
            if closing is not None and not open_at:
                char = text[at]
                if char in ":}" and not text.startswith(":=", at) or char == "!" and not text.startswith("!=", at):
                    return at
                if char == ":":
                    return at
                if char == "=" and re.compile(r"=\s*[!:}]").match(text, at) and not text.startswith("==", at):
                    self.put("\x07", at)
                    at += 1
                    continue
            m = _TOKEN.match(text, at)
            if not m:
                raise LayoutError(at)
            kind, piece, at = m.lastgroup, m.group(), m.end()
            if kind == "blank":
                self.put(" ", m.start())
            elif kind == "comment":
                pass
            elif kind == "newline":
                if closing is None and not open_at:
                    return at
                self.put(" ", m.start())
            elif kind == "format":
                at = self._format(m.start(), at, piece)
            elif kind == "quote" or kind == "number" and _LEADING_ZERO.match(piece):
                raise LayoutError(m.start())
            elif kind == "string":
                self.put("''", m.start())
            else:
                if kind == "open":
                    open_at.append(piece)
                elif kind == "close":
                    if not open_at or open_at.pop() != _PAIRS[piece]:
                        raise LayoutError(m.start())
                self.put(piece, m.start())
        if open_at or closing is not None:
            raise LayoutError(len(text))
        return at

    def _format(self, start: int, at: int, prefix: str) -> int:
        quote = prefix.lstrip("fFrR")
        raw = "r" in prefix.lower()
        self.put(FORMAT, start)
        at = self._pieces(at, quote, raw, False)
        self.put(FORMAT_END, at)
        return at + len(quote)

    def _pieces(self, at: int, quote: str, raw: bool, spec: bool) -> int:
        """Literal text and replacement fields up to the closing quote, in a format spec up to ``}``."""
        text = self.text
        while True:
            if at >= len(text):
                raise LayoutError(len(text))
            char = text[at]
            if spec and char == "}":
                return at
            if text.startswith(quote, at):
                if spec:
                    raise LayoutError(at)
                return at
            if char == "\\" and not raw:
                named = re.compile(r"\\N\{[^}\n]*\}").match(text, at)
                at = named.end() if named else at + 2
            elif char == "{" and text.startswith("{{", at) and not spec:
                at += 2
            elif char == "{":
                at = self._field(at, quote, raw)
            elif char == "}" and not spec:
                if not text.startswith("}}", at):
                    raise LayoutError(at)
                at += 2
            elif char in "\r\n" and len(quote) == 1 and not spec:
                raise LayoutError(at)
            else:
                at += 1

    def _field(self, at: int, quote: str, raw: bool) -> int:
        text = self.text
        self.put("{", at)
        at = self._tokens(at + 1, "}")
        if text.startswith("!", at):
            m = re.compile(r"!\s*[sra](?!\w)\s*").match(text, at)
            if not m:
                raise LayoutError(at)
            at = m.end()
        if text.startswith(":", at):
            self.put(":", at)
            at = self._pieces(at + 1, quote, raw, True)
        if not text.startswith("}", at):
            raise LayoutError(at)
        self.put("}", at)
        return at + 1


_KEYWORDS = (
    "False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|"
    "if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield"
)

PYTHON = r"""
NL <- ⟨\x01⟩
Stmt <- Compound / SimpleLine
SimpleLine <- Simple (';' Simple)* ';'? NL
Block <- NL ⟨\x02⟩ Stmt+ ⟨\x03⟩ / SimpleLine
Name <- ⟨(?!(?:KEYWORDS)(?!\w))[^\W\d]\w*⟩
Dotted <- Name ('.' Name)*

Simple <- "return" StarExprs? / "import" ImportAs (',' ImportAs)* / FromImport / "raise" (Expr ("from" Expr)?)? / "pass" / "break" / "continue"
  / "del" DelTarget (',' DelTarget)* ','? / "assert" Expr (',' Expr)? / "global" Name (',' Name)* / "nonlocal" Name (',' Name)*
  / TypeAlias / Assignment / YieldExpr / StarExprs
ImportAs <- Dotted ("as" Name)?
FromImport <- "from" (⟨\.⟩ / ⟨\.\.\.⟩)* Dotted? "import" ('*' / '(' FromName (',' FromName)* ','? ')' / FromName (',' FromName)*)
FromName <- Name ("as" Name)?
TypeAlias <- "type" Name TypeParams? '=' Expr
Assignment <- (AttrSub / Name / '(' Single ')') ':' Expr ('=' (YieldExpr / StarExprs))?
  / (StarTargets ⟨=(?!=)⟩)+ (YieldExpr / StarExprs) / Single ⟨(?:\*\*|//|>>|<<|[+\-*/%&|^@])=⟩ (YieldExpr / StarExprs)
Single <- AttrSub / Name / '(' Single ')'
StarTargets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' !⟦\*⟧ StarTarget / Target
Target <- AttrSub / Name / '(' StarTargets? ')' / '[' StarTargets? ']'
DelTarget <- AttrSub / Name / '(' (DelTarget (',' DelTarget)* ','?)? ')' / '[' (DelTarget (',' DelTarget)* ','?)? ']'
AttrSub <- Atom (Suffix &⟦[.(\[]⟧)* (Attribute / Subscript) !⟦[.(\[]⟧

Compound <- Decorated / If / For / While / Try / With / Match
Decorated <- ('@' NamedExpr NL)* (Def / Class)
Def <- "async"? "def" Name TypeParams? '(' ParamList? ')' ('->' Expr)? ':' Block
Class <- "class" Name TypeParams? ('(' Args? ')')? ':' Block
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('**' / '*')? Name (':' Expr)? ('=' StarExpr)?
ParamList <- Placed (',' Starred)? ','? / Starred ','?
Placed <- Bares ',' '/' (',' Bares)? (',' Defaults)? / Bares ',' Defaults ',' '/' (',' Defaults)? / Bares (',' Defaults)? / Defaults ',' '/' (',' Defaults)? / Defaults
Bares <- Bare (',' Bare)*
Bare <- Name (':' Expr)? !⟦=⟧
Defaults <- Default (',' Default)*
Default <- Name (':' Expr)? ⟨=(?!=)⟩ Expr
Starred <- '*' Name (':' StarExpr)? (',' (Default / Bare))* (',' Keywords)? / '*' (',' (Default / Bare))+ (',' Keywords)? / Keywords
Keywords <- '**' Name (':' Expr)?
If <- "if" NamedExpr ':' Block ("elif" NamedExpr ':' Block)* ("else" ':' Block)?
For <- "async"? "for" StarTargets "in" StarExprs ':' Block ("else" ':' Block)?
While <- "while" NamedExpr ':' Block ("else" ':' Block)?
Try <- "try" ':' Block ("finally" ':' Block / Except+ ("else" ':' Block)? ("finally" ':' Block)?)
Except <- "except" '*'? (Expr ("as" Name)?)? ':' Block
With <- "async"? "with" ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Expr "as" StarTarget &⟦[,):]⟧ / Expr
Match <- "match" (StarNamed ',' StarNameds? / NamedExpr) ':' NL ⟨\x02⟩ Case+ ⟨\x03⟩
Case <- "case" (StarPattern ',' Patterns? / Pattern) ("if" NamedExpr)? ':' Block
Patterns <- StarPattern (',' StarPattern)* ','?
StarPattern <- '*' Name / Pattern
Pattern <- OrPattern ("as" Name)?
OrPattern <- ClosedPattern ('|' ClosedPattern)*
ClosedPattern <- Strings / ⟨-⟩? Number (⟨[+-]⟩ Number)? / "None" / "True" / "False" / Dotted ('(' (ArgPattern (',' ArgPattern)* ','?)? ')')?
  / '(' Patterns? ')' / '[' Patterns? ']' / '{' (KeyPattern (',' KeyPattern)* ','?)? '}'
ArgPattern <- Name '=' Pattern / Pattern
KeyPattern <- '**' Name / ClosedPattern ':' Pattern

Expr <- Lambda / Disj ("if" Disj "else" Expr)?
NamedExpr <- Name ':=' Expr / Expr
StarExpr <- '*' BitOr / Expr
StarExprs <- StarExpr (',' StarExpr)* ','?
StarNamed <- '*' BitOr / NamedExpr
StarNameds <- StarNamed (',' StarNamed)* ','?
YieldExpr <- "yield" ("from" Expr / StarExprs)?
Lambda <- "lambda" (LambdaList ','?)? ':' Expr
LambdaList <- LambdaPlaced (',' LambdaStarred)? / LambdaStarred
LambdaPlaced <- Names ',' '/' (',' Names)? (',' Givens)? / Names ',' Givens ',' '/' (',' Givens)? / Names (',' Givens)? / Givens ',' '/' (',' Givens)? / Givens
Names <- Name !⟦=⟧ (',' Name !⟦=⟧)*
Givens <- Given (',' Given)*
Given <- Name ⟨=(?!=)⟩ Expr
LambdaStarred <- '*' Name (',' (Given / Name))* (',' '**' Name)? / '*' (',' (Given / Name))+ (',' '**' Name)? / '**' Name
Disj <- Inversion (⟨(?:and|or)(?!\w)⟩ Inversion)*
Inversion <- "not"* BitOr (CompareOp BitOr)*
CompareOp <- ⟨(?:==|!=|<=|>=|<(?!<)|>(?!>)|not +in(?!\w)|in(?!\w)|is +not(?!\w)|is(?!\w))⟩
BitOr <- Factor (⟨(?:\*\*(?!=)|//(?!=)|<<(?!=)|>>(?!=)|[+*/%&|^@-](?!=))⟩ Factor)*
Factor <- ⟨[+~-]⟩* "await"? Primary
Primary <- Atom Suffix*
Suffix <- Attribute / Subscript / '(' Args? ')'
Attribute <- '.' Name
Subscript <- '[' Slice (',' Slice)* ','? ']'
Slice <- Expr? ':' Expr? (':' Expr?)? / '*' BitOr / NamedExpr
Args <- Positional (',' Positional)* (',' Keyword)* ','? / Keyword (',' Keyword)* ','?
Positional <- '*' Expr / !(Name ⟨=(?!=)⟩) !'**' NamedExpr ForIf*
Keyword <- '**' Expr / '*' Expr / Name ⟨=(?!=)⟩ Expr
ForIf <- "async"? "for" StarTargets "in" Disj ("if" Disj)*
Atom <- Name / ⟨(?:True|False|None)(?!\w)⟩ / Strings / Number / '...' / Paren / List / Braces
Number <- ⟨(?:\d|\.\d)(?:[eE][+-]\d|[\w.])*⟩
Strings <- ("''" / Format)+
Format <- ⟦\x05⟧ Field* ⟨\x06⟩
Field <- ⟦\{⟧ Skip (YieldExpr / StarExprs) ⟨\x07⟩? (⟦:⟧ Field*)? ⟦\}⟧
Skip <- ⟨⟩
Paren <- '(' ')' / '(' YieldExpr ')' / '(' NamedExpr ForIf* ')' / '(' StarNamed ',' StarNameds? ')'
List <- '[' ']' / '[' NamedExpr ForIf+ ']' / '[' StarNameds ']'
Braces <- '{' '}' / '{' Expr ':' Expr ForIf+ '}' / '{' DictItem (',' DictItem)* ','? '}' / '{' NamedExpr ForIf+ '}' / '{' StarNameds '}'
DictItem <- '**' BitOr / Expr ':' Expr
""".replace("KEYWORDS", _KEYWORDS).replace("\"''\"", "⟨''⟩")

JSON = r"""
Text <- Value End
End <- !⟦[\s\S]⟧
Value <- Object / Array / String / ⟨-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?⟩ / 'true' / 'false' / 'null'
Object <- '{' (Pair (',' Pair)*)? '}'
Pair <- String ':' Value
Array <- '[' (Value (',' Value)*)? ']'
String <- ⟨"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"⟩
"""
#: Blanks that JSON allows between tokens.
JSON_TRIVIA = r"[ \t\r\n]*+"
