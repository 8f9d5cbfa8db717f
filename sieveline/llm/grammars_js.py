"""Grammars of JavaScript modules, TypeScript, and TypeScript with markup (tsx).

Written from the public language references. The grammars accept a little more than a compiler does
(they do not check types, scopes or assignment targets), but every accepted text is built from whole
declarations, statements and expressions.
"""

from __future__ import annotations

#: Blanks and comments.
TRIVIA = r"(?>(?:[\s﻿]++|//[^\n\r  ]*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+)"


def newline_before(text: str, at: int) -> bool:
    """Only blanks or a comment, with a line break among them, lie between the last token and here."""
    while at > 0:
        char = text[at - 1]
        if char in "\n\r  ":
            return True
        if char in " \t\f\v ﻿":
            at -= 1
        elif char == "/" and text[at - 2 : at] == "*/":
            start = text.rfind("/*", 0, at - 2)
            if start < 0:
                return False
            if "\n" in text[start:at]:
                return True
            at = start
        else:
            return False
    return True


_RESERVED = (
    "await|break|case|catch|class|const|continue|debugger|default|delete|do|else|enum|export|extends|false|finally|"
    "for|function|if|implements|import|in|instanceof|interface|let|new|null|package|private|protected|public|return|"
    "static|super|switch|this|throw|true|try|typeof|var|void|while|with|yield"
)
_IDENT = r"(?:[\w$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|[^\x00-\x7f\s‘-‟…–—«»→�])++"

BASE = (
    r"""
End <- !⟦[\s\S]⟧
Item <- ImportDecl / ExportDecl / Stmt
NL <- ^newline
Semi <- ';' / &⟦\}⟧ / End / NL

Name <- ⟨(?!\d)IDENT⟩
Ident <- ⟨(?!(?:RESERVED)(?![\w$]))(?!\d)IDENT⟩
PrivateName <- ⟨\#(?!\d)IDENT⟩
Number <- ⟨(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:(?:0|[1-9](?:_?\d)*)(?:n(?![\w$])|(?:\.(?:\d(?:_?\d)*)?)?)|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$])⟩
String <- ⟨'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'⟩ / ⟨"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"⟩
Regex <- ⟨/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[dgimsuvy]*+(?![\w$])⟩
Template <- ⟦`⟧ TemplateText (⟦\$\{⟧ Skip Expr ⟦\}⟧ TemplateText)* '`'
TemplateText <- ⟦(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+⟧
Skip <- ⟨⟩

ImportDecl <- "import" !⟦[(.]⟧ (String / ImportClause "from" String) ImportWith? Semi
ImportClause <- '*' "as" Ident / NamedImports / Ident (',' ('*' "as" Ident / NamedImports))?
NamedImports <- '{' (ImportSpec (',' ImportSpec)* ','?)? '}'
ImportSpec <- (Name / String) "as" Ident / Ident
ImportWith <- ⟨(?:with|assert)(?![\w$])⟩ ObjectLit
ExportDecl <- "export" ( "default" (FuncDecl / ClassDecl / !⟦(?:async\s+)?(?:function|class)(?![\w$])⟧ Assign Semi)
  / '*' ("as" (Name / String))? "from" String ImportWith? Semi
  / NamedExports ("from" String ImportWith?)? Semi
  / Decl )
NamedExports <- '{' (ExportSpec (',' ExportSpec)* ','?)? '}'
ExportSpec <- (Name / String) ("as" (Name / String))?

Decl <- FuncDecl / ClassDecl / VarStmt
Stmt <- Block / VarStmt / FuncDecl / ClassDecl / ';' / IfStmt / ForStmt / WhileStmt / DoStmt / SwitchStmt / TryStmt
  / "return" (!NL Expr)? Semi / "throw" !NL Expr Semi / ⟨(?:break|continue)(?![\w$])⟩ (!NL Ident)? Semi
  / "debugger" Semi / Ident ':' Stmt / ExprStmt
ExprStmt <- !⟦(?:\{|(?:function|class)(?![\w$])|async\s+function(?![\w$])|let\s*\[)⟧ Expr Semi
Block <- '{' Stmt* '}'
VarStmt <- VarDecls Semi
VarDecls <- ⟨(?:var|const|let)(?![\w$])⟩ VarDecl (',' VarDecl)*
VarDecl <- Binding ('=' Assign)?
Binding <- ObjectBinding / ArrayBinding / Ident
ObjectBinding <- '{' (BindingProp (',' BindingProp)* ','?)? '}'
BindingProp <- '...' Binding / PropName ':' Binding ('=' Assign)? / Ident ('=' Assign)?
ArrayBinding <- '[' (','* ArrayBindingEl (',' ArrayBindingEl?)*)? ','* ']'
ArrayBindingEl <- '...'? Binding ('=' Assign)?
IfStmt <- "if" '(' Expr ')' Stmt ("else" Stmt)?
ForStmt <- "for" "await"? '(' ( ⟨(?:var|const|let)(?![\w$])⟩ Binding ⟨(?:of|in)(?![\w$])⟩ Expr
  / Postfix ⟨(?:of|in)(?![\w$])⟩ Expr / (VarDecls / Expr)? ';' Expr? ';' Expr? ) ')' Stmt
WhileStmt <- "while" '(' Expr ')' Stmt
DoStmt <- "do" Stmt "while" '(' Expr ')' ';'?
SwitchStmt <- "switch" '(' Expr ')' '{' (("case" Expr / "default") ':' Stmt*)* '}'
TryStmt <- "try" Block ("catch" ('(' CatchParam ')')? Block ("finally" Block)? / "finally" Block)
CatchParam <- Binding

FuncDecl <- ("async" !NL)? "function" '*'? Ident? FuncRest
FuncRest <- Params FuncBody
FuncBody <- '{' Stmt* '}'
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- '...'? Binding ('=' Assign)?
ClassDecl <- Decorator* ClassExpr
ClassExpr <- "class" (!⟦(?:extends|implements)(?![\w$])⟧ Ident)? Heritage ClassBody
Heritage <- ("extends" Postfix)?
ClassBody <- '{' Member* '}'
Decorator <- '@' Postfix
Member <- ';' / "static" Block / Decorator* Modifier* '*'? ClassName (Params FuncBody / ('=' Assign)? Semi)
Modifier <- ⟨(?:static|async|get|set|accessor)(?![\w$])(?!\s*[=(;}])⟩
ClassName <- PrivateName / PropName
PropName <- Name / String / Number / '[' Assign ']'

Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / Cond (AssignOp Assign)?
AssignOp <- ⟨(?:=(?![=>])|\+=|-=|\*=|/=|%=|\*\*=|<<=|>>=|>>>=|&=|\^=|\|=|&&=|\|\|=|\?\?=)⟩
Yield <- "yield" (!NL '*'? Assign)?
Arrow <- ("async" !NL)? (Ident / ArrowParams) !NL '=>' (FuncBody / !⟦\{⟧ Assign)
ArrowParams <- Params
Cond <- Binary ('?' !⟦\.\D⟧ Assign ':' Assign)?
Binary <- Unary BinaryRest*
BinaryRest <- BinaryOp Unary
BinaryOp <- ⟨(?:>>>(?!=)|>>(?![>=])|<<(?!=)|===|!==|==(?!=)|!=|<=|>=|&&(?!=)|\|\|(?!=)|\?\?(?!=)|\*\*(?!=)|[*%&|^](?!=)|/(?!=)|\+(?![+=])|-(?![-=])|[<>]|(?:instanceof|in)(?![\w$]))⟩
Unary <- ⟨(?:(?:delete|void|typeof|await)(?![\w$])|\+\+|--|[+\-!~])⟩ Unary / Postfix
Postfix <- Chain (!NL ⟨(?:\+\+|--)⟩)?
Chain <- Primary Suffix*
Suffix <- '?.' (Args / '[' Expr ']' / PrivateName / Name / Template) / '.' (PrivateName / Name) / '[' Expr ']' / Args / Template
Args <- '(' (Arg (',' Arg)* ','?)? ')'
Arg <- '...'? Assign
New <- "new" ('.' "target" / NewTarget Args?)
NewTarget <- New / Primary ('.' (PrivateName / Name) / '[' Expr ']' / Template)*
Primary <- ⟨(?:this|null|true|false|super)(?![\w$])⟩ / Number / String / Template / Regex / ArrayLit / ObjectLit / FuncExpr
  / Decorator* ClassExpr / New / "import" ('(' Assign (',' Assign)* ','? ')' / '.' Name) / '(' Expr ')' / Ident / PrivateName &⟦in\b⟧
FuncExpr <- ("async" !NL)? "function" '*'? Ident? FuncRest
ArrayLit <- '[' ','* (Arg (',' Arg?)*)? ']'
ObjectLit <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / PropModifier* '*'? PropName FuncRest / PropName ':' Assign / Ident ('=' Assign)?
PropModifier <- ⟨(?:async|get|set)(?![\w$])(?!\s*[=(:,}])⟩
""".replace("RESERVED", _RESERVED).replace("IDENT", _IDENT)
)

#: What TypeScript adds; a rule given again replaces the one above.
TYPES = (
    r"""
Item <- ImportDecl / ExportDecl / Stmt
ImportDecl <- "import" !⟦[(.]⟧ ( String ImportWith? Semi / ("type" !⟦from\b⟧ / "type" &⟦from\s+from\b⟧)? ImportClause "from" String ImportWith? Semi
  / "type"? Ident '=' ("require" '(' String ')' / Entity) Semi )
ImportSpec <- "type" !⟦as\b(?!\s+as\b)⟧ ((Name / String) "as" Ident / Ident) / (Name / String) "as" Ident / Ident
ExportDecl <- Decorator* "export" ( "default" (FuncDecl / ClassDecl / Interface / !⟦(?:async\s+)?(?:function|class|interface)(?![\w$])⟧ Assign Semi)
  / "type"? '*' ("as" (Name / String))? "from" String ImportWith? Semi
  / "type"? NamedExports ("from" String ImportWith?)? Semi
  / '=' Expr Semi / "as" "namespace" Ident Semi / "import" Ident '=' ("require" '(' String ')' / Entity) Semi
  / Decl )
ExportSpec <- "type" !⟦as\b(?!\s+as\b)⟧ !⟦[,\}}]⟧ (Name / String) ("as" (Name / String))? / (Name / String) ("as" (Name / String))?

Decl <- Ambient / FuncDecl / ClassDecl / VarStmt
Ambient <- Interface / TypeAlias / Enum / Namespace / Declare
Interface <- "interface" Ident TypeParams? ("extends" TypeRef (',' TypeRef)*)? ObjectType
TypeAlias <- "type" !NL Ident TypeParams? '=' Type Semi
Enum <- ("const" )? "enum" Ident '{' (EnumMember (',' EnumMember)* ','?)? '}'
EnumMember <- PropName ('=' Assign)?
Namespace <- (⟨(?:namespace|module)(?![\w$])⟩ !NL (String / Ident ('.' Name)*) / "global" &⟦\{⟧) (NamespaceBody / Semi)
NamespaceBody <- '{' Item* '}'
Declare <- "declare" !NL ("global" NamespaceBody / "const"? &"enum" Enum / Ambient / FuncDecl / ClassDecl / VarStmt)
Stmt <- Block / Enum / VarStmt / FuncDecl / ClassDecl / Ambient / ';' / IfStmt / ForStmt / WhileStmt / DoStmt / SwitchStmt / TryStmt
  / "return" (!NL Expr)? Semi / "throw" !NL Expr Semi / ⟨(?:break|continue)(?![\w$])⟩ (!NL Ident)? Semi
  / "debugger" Semi / Ident ':' Stmt / ExprStmt
VarDecl <- Binding '!'? TypeAnn? ('=' Assign)?
CatchParam <- Binding TypeAnn?
FuncDecl <- ("async" !NL)? "function" '*'? Ident? TypeParams? Params ReturnType? (FuncBody / Semi)
FuncRest <- TypeParams? Params ReturnType? FuncBody
Param <- Decorator* ParamModifier* ('...'? Binding '?'? TypeAnn? ('=' Assign)? / "this" TypeAnn?)
ParamModifier <- ⟨(?:public|private|protected|readonly|override)(?![\w$])(?=\s*[\w$\[{])⟩
ClassDecl <- Decorator* "abstract"? ClassExpr
ClassExpr <- "class" (!⟦(?:extends|implements)(?![\w$])⟧ Ident)? TypeParams? Heritage ClassBody
Heritage <- ("extends" Postfix TypeArgs?)? ("implements" TypeRef (',' TypeRef)*)?
Member <- ';' / "static" Block / Decorator* Modifier* ( IndexSignature Semi
  / '*'? ClassName ⟨[?!]⟩? ( TypeParams? Params ReturnType? (FuncBody / Semi) / TypeAnn? ('=' Assign)? Semi ) )
Modifier <- ⟨(?:static|async|get|set|accessor|public|private|protected|readonly|abstract|override|declare)(?![\w$])(?!\s*[=(;}:?!<,])⟩
IndexSignature <- '[' Ident ':' Type ']' TypeAnn?
Arrow <- ("async" !NL)? (Ident / ArrowParams) !NL '=>' (FuncBody / !⟦\{⟧ Assign)
ArrowParams <- TypeParams? Params ReturnType?
Cond <- Binary ('?' !⟦\.\D⟧ (Assign ':' Assign / PlainAssign ':' Assign))?
PlainAssign <- ("async" !NL)? TypeParams? Params !NL '=>' (FuncBody / !⟦\{⟧ Assign) / Cond (AssignOp Assign)?
BinaryRest <- !NL ⟨(?:as|satisfies)(?![\w$])⟩ ("const" / Type) / BinaryOp Unary
Unary <- ⟨(?:(?:delete|void|typeof|await)(?![\w$])|\+\+|--|[+\-!~])⟩ Unary / Cast / Postfix
Cast <- '<' ("const" / Type) '>' Unary
Suffix <- '?.' (TypeArgs? Args / '[' Expr ']' / PrivateName / Name / Template) / '.' (PrivateName / Name) / '[' Expr ']' / Args / Template
  / !NL ⟨!(?!=)⟩ / TypeArgs &⟦[(`)\]:;,.?|&=\}]|\Z⟧
NewTarget <- New / Primary ('.' (PrivateName / Name) / '[' Expr ']' / Template)* TypeArgs?

TypeAnn <- ':' Type
ReturnType <- ':' (Predicate / Type)
Predicate <- "asserts" !NL (Ident / "this") ("is" Type)? / (Ident / "this") !NL "is" Type
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ⟨(?:const|in|out)(?![\w$])(?=\s+[\w$])⟩* Ident ("extends" Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* ','? '>'
TypeRef <- Entity TypeArgs?
Entity <- (Ident / ⟨(?:this|void|null)(?![\w$])⟩) ('.' Name)*
Type <- FuncType / UnionType ("extends" !NL UnionType '?' Type ':' Type / "extends" UnionType '?' Type ':' Type)?
FuncType <- TypeParams? Params '=>' (Predicate / Type) / "abstract"? "new" TypeParams? Params '=>' Type
UnionType <- '|'? InterType ('|' InterType)*
InterType <- '&'? TypeOp ('&' TypeOp)*
TypeOp <- FuncType / ⟨(?:keyof|unique|readonly)(?![\w$])(?!\s*[;,)=|&>\]])⟩ TypeOp / "infer" Ident ("extends" UnionType !⟦\?⟧)? / ArrayType
ArrayType <- PrimType (!NL '[' Type? ']')*
PrimType <- '(' Type ')' / TupleType / ObjectType / TemplateType / String / '-'? Number / ⟨(?:true|false|undefined)(?![\w$])⟩
  / "typeof" ("import" '(' String ')' / Entity) ('.' Name)* TypeArgs? / "import" '(' Type (',' ObjectLit)? ')' ('.' Name)* TypeArgs? / TypeRef
TupleType <- '[' (TupleEl (',' TupleEl)* ','?)? ']'
TupleEl <- '...'? (Name '?'? ':' Type / Type '?'?)
TemplateType <- ⟦`⟧ TemplateText (⟦\$\{⟧ Skip Type ⟦\}⟧ TemplateText)* '`'
ObjectType <- '{' MappedType '}' / '{' (TypeMember (';' / ',' / &⟦\}⟧ / NL))* '}'
MappedType <- (⟨[+-]?⟩ "readonly")? '[' Ident "in" Type ("as" Type)? ']' (⟨[+-]?\?⟩)? TypeAnn? ';'?
TypeMember <- "new"? TypeParams? Params ReturnType? / TypeModifier* IndexSignature
  / TypeModifier* PropName '?'? (TypeParams? Params ReturnType? / TypeAnn?)
TypeModifier <- ⟨(?:readonly|get|set)(?![\w$])(?!\s*[(:?;,}<])⟩
"""
)

#: Markup, for tsx; type assertions in angle brackets do not exist there.
MARKUP = (
    r"""
Unary <- ⟨(?:(?:delete|void|typeof|await)(?![\w$])|\+\+|--|[+\-!~])⟩ Unary / Postfix
Primary <- Element Skip / ⟨(?:this|null|true|false|super)(?![\w$])⟩ / Number / String / Template / Regex / ArrayLit / ObjectLit / FuncExpr
  / Decorator* ClassExpr / New / "import" ('(' Assign (',' Assign)* ','? ')' / '.' Name) / '(' Expr ')' / Ident / PrivateName &⟦in\b⟧
Element <- '<' n=TagName Skip TypeArgs? Attribute* ( '/' ⟦>⟧ / ⟦>⟧ Child* '<' '/' @n Skip ⟦>⟧ ) / '<' ⟦>⟧ Child* '<' '/' ⟦>⟧
TagName <- ⟦[\w$][\w$\-]*(?:[.:][\w$\-]+)*⟧
Attribute <- '{' '...' Assign '}' / ⟨[\w$][\w$\-]*(?::[\w$\-]+)?⟩ ('=' (AttrString / '{' Assign '}' / Element Skip))?
AttrString <- ⟨"[^"]*"⟩ / ⟨'[^']*'⟩
Child <- ⟦[^<>{}]+⟧ / ⟦\{⟧ Skip ('...'? Expr)? ⟦\}⟧ / Element
"""
)
