"""Lexers and grammars of the code languages for the recogniser in gll.py."""

from __future__ import annotations

import re
from functools import cache

from .gll import Grammar

# One line per class: its name, then the tokens it stands for (the name alone when none follow). Words that are in no
# class are identifiers.
_C_STRINGS = r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"' + r"|(?:u8|[uUL])?'(?:[^'\\\n]|\\[\s\S])+'"
_NUMBER = r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bBoO][0-7_]+|\.?\d(?:[\d_]|\.(?!\.)|[eE][+-]?(?=\d)|')*)[A-Za-z_]\w*|(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|\.?\d(?:[\d_]|\.(?!\.|[A-Za-z_])|[eE][+-]?(?=\d))*)"
_COMMENTS = r"/\*[\s\S]*?\*/|//[^\n]*"
# Templates may hold expressions with templates, and Rust's block comments comments; both are followed some levels deep.
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\})*+\})*+`"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
for _ in range(3):
    _TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|" + _TEMPLATE + r")*+\}|" + _TEMPLATE + r")*+\})*+`"
    _NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|" + _NESTED + r")*+\*/"

LEXERS = {
    "python": r"""(?:[fFtT][rR]?|[rR][fFtT])(?:"(?!"")(?:[^"\\\n{]|\\[\s\S]|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*"|'(?!'')(?:[^'\\\n{]|\\[\s\S]|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*')|[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
    r"|\#[^\n]*|\\\r?\n[ \t]*|\n[ \t\f]*|[^\W\d]\w*|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)[jJ]?(?![^\W\d])|:=|->|\.\.\.|\*\*=|//=|>>=|<<=|[-+*/%&|^@]=|==|!=|<=|>=|\*\*|//|<<|>>|[^\s]",
    "javascript": _COMMENTS
    + r"|(?:=>|&&|\|\||[=!]==?|[(,=:\[!&|?;{}+]|\breturn\b|\bcase\b|\btypeof\b)\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    + r"""|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|"""
    + _TEMPLATE
    + r"""|`(?:[^`\\]|\\[\s\S])*`|\n|[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*|"""
    + r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)n?(?![\w$])|>>>=|\*\*=|&&=|\|\|=|\?\?=|<<=|>>=|===|!==|\.\.\.|=>|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|\*\*|[-+*/%&|^]=|[=!<>]=|<<|\S",
    "java": _COMMENTS + r'|"""[\s\S]*?"""|' + _C_STRINGS + r"|@interface\b|[^\W\d][\w$]*|\$[\w$]*|" + _NUMBER + r"|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|>>>=|>>=|[-+*/%&|^]=|==|!=|<=|<<|\S",
    "go": _COMMENTS + r"""|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^'\n]*)[^'\n]{0,9}?'|\n|[^\W\d]\w*|""" + _NUMBER + r"|\.\.\.|<-|:=|\+\+|--|&&|\|\||&\^=?|<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|<<|>>|\S",
    "rust": _NESTED
    + r"""|//[^\n]*|b?r(#*)"[\s\S]*?"\1|b?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\[^'\n]+|\\')'|'[^\W\d]\w*|(?:r\#)?[^\W\d]\w*|"""
    + r"(?:0[xX][\da-fA-F_]+|0[bBoO][0-7_]+|\d[\d_]*(?:\.(?!\.|[^\W\d])[\d_]*)?(?:[eE][+-]?\d+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)|\.\.=|\.\.\.|\.\.|::|->|=>|&&|\|\||<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|<<|\S",
    "c": _COMMENTS + r"|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*|" + _C_STRINGS + r"|[^\W\d]\w*|" + _NUMBER + r"|\.\.\.|->|\+\+|--|&&|\|\||<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|<<|>>|\S",
    "cpp": _COMMENTS + r'|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*|R"(?P<d>\w*)\([\s\S]*?\)(?P=d)"|' + _C_STRINGS + r"|[^\W\d]\w*|" + _NUMBER + r"|\.\.\.|->\*?|::|\+\+|--|&&|\|\||<<=|>>=|<=>|[-+*/%&|^]=|==|!=|<=|<<|\S",
}
LEXERS["typescript"] = LEXERS["javascript"]

_TOKENS = {
    "python": """def class if elif else for while try except finally with as import from return pass break continue raise yield
lambda in is not and or await async del global nonlocal assert match case type None True False = := -> : , . ; @ * ** / ~
+-:+ -
asg:+= -= *= /= //= %= &= |= ^= >>= <<= **= @=
bin:// % & | ^ << >> == != <= >= < >""",
    "javascript": """import export default from as function class extends const let var if else for while do return throw break continue try
catch finally switch case new in of async await yield get set static this super typeof void instanceof debugger with asserts module
= ; , . ? : => ?. ... * + - ! < > & | ++ { } interface type enum namespace declare abstract implements readonly keyof is infer satisfies
inc:++ --
pre:~ delete
acc:public private protected override accessor
asg:+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
bin:/ % ** == != === !== <= >= && || ?? ^ <<""",
    "java": """package import class interface enum record extends implements permits throws static default if else while do for switch case
try catch finally return throw break continue synchronized assert yield new super instanceof @ @interface
= ; , . ? : -> :: ... * & | < > + - ! ~
inc:++ --
mod:public private protected final abstract native transient volatile strictfp sealed
asg:+= -= *= /= %= &= |= ^= <<= >>= >>>=
bin:/ % == != <= && || ^ <<""",
    "go": """package import func var const type struct interface map chan if else for range switch case default select go defer return break
continue goto fallthrough = := : ; , . ... * & ! ^ <- + - | ~
inc:++ --
asg:+= -= *= /= %= &= |= ^= <<= >>= &^=
bin:/ % == != < <= > >= && || << >> &^""",
    "rust": """use mod fn struct enum union impl trait const static type extern crate pub unsafe async await move let mut ref if else match loop
while for in where as dyn return break continue self super box macro_rules
= ; , . : :: -> => ? ! # $ @ * & && | || < > + - .. ... ..=
asg:+= -= *= /= %= &= |= ^= <<= >>=
bin:/ % == != <= >= ^ <<""",
    "c": """struct union enum extern if else while do for switch case default return break continue goto sizeof asm try catch throw new delete
class namespace using template typename operator noexcept decltype static_assert public private protected final override concept requires co_return co_await co_yield this
_Generic = ; , . ? : -> :: ... * & && < > + - ! ~
inc:++ --
q:static const volatile inline register typedef constexpr consteval constinit virtual explicit friend mutable thread_local restrict _Noreturn __inline __restrict _Atomic __extension__
ty:int char short long float double void unsigned signed bool auto _Bool wchar_t char8_t char16_t char32_t __int128
asg:+= -= *= /= %= &= |= ^= <<= >>=
bin:/ % == != <= >= || | ^ << >> ->* <=>""",
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_TOKENS["cpp"] = _TOKENS["c"]
_CPP_ONLY = "try catch throw new delete class namespace using template typename operator noexcept decltype static_assert public private protected final override concept requires co_return co_await co_yield this ::".split()

RULES = {}
RULES["python"] = """
File = Stmt*
Suite = Stmt+
Id = 'i' | 'match' | 'case' | 'type'
Stmt = Simple (';' Simple)* ';'? 'NL' | Compound
Body = ':' (Simple (';' Simple)* ';'? 'NL' | 'NL' <:Suite:>)
Compound = 'if' Ex Body ('elif' Ex Body)* ('else' Body)? | 'while' Ex Body ('else' Body)? | 'async'? 'for' Goals 'in' Stars Body ('else' Body)?
 | 'try' Body (Except+ ('else' Body)? ('finally' Body)? | 'finally' Body) | 'async'? 'with' (With (',' With)* | (:Withs:)) Body
 | Deco* 'async'? 'def' Id [:TypeParams:]? (:Params:) ('->' List)? Body | Deco* 'class' Id [:TypeParams:]? (:Args:)? Body | 'match' List ':' 'NL' <:Cases:>
Except = 'except' '*'? (List ('as' Id)?)? Body
With = Ex ('as' Spot)?
Withs = With (',' With)* ','?
Deco = '@' Ex 'NL'
Cases = ('case' Pats ('if' Ex)? Body)+
Pats = Pat (',' Pat)* ','?
Pat = '*'? Or ('as' Id)?
Simple = Stars | (Goals '=')+ (Stars | Yield) | Goal ':' Ex ('=' (Stars | Yield))? | Goal 'asg' (Stars | Yield) | Yield | 'pass' | 'break' | 'continue' | 'del' Dels | 'return' Stars?
 | 'raise' (Ex ('from' Ex)?)? | 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | 'from' ('.'* Dotted | '.'+) 'import' ('*' | (:Names:) | Name (',' Name)*)
 | 'global' Id (',' Id)* | 'nonlocal' Id (',' Id)* | 'assert' Ex (',' Ex)? | 'type' Id [:TypeParams:]? '=' Ex
Goal = Id | Atom Post* ('.' Id | [:Subs:]) | (:Goal:)
Goals = '*'? Spot (',' '*'? Spot)* ','?
Spot = Goal | (:Inner:) | [:Inner:]
Inner = Goals?
Dels = Del (',' Del)* ','?
Del = Goal | (:DelIn:) | [:DelIn:]
DelIn = Dels?
Dotted = Id ('.' Id)*
Name = Id ('as' Id)?
Names = Name (',' Name)* ','?
Yield = 'yield' ('from' Ex | Stars)?
List = Ex (',' Ex)* ','?
Stars = Star (',' Star)* ','?
Star = '*'? Ex
Ex = Tern | Id ':=' Ex
Tern = Or ('if' Or 'else' Ex)? | 'lambda' (Lead (',' LRest)? ','? | LRest ','?)? ':' Ex
Or = Un (Bin Un)*
Bin = 'bin' | '+-' | '*' | '**' | '/' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'?
Un = ('not' | '+-' | '~' | 'await')* Prim Post*
Prim = Atom
Atom = Id | 'None' | 'True' | 'False' | 'n' | 's'+ | (:Paren:) | [:ListC:] | {:DictC:}
Post = '.' Id | (:Args:) | [:Subs:]
Paren = (Stars | Yield | Ex For+)?
ListC = (Stars | Star For+)?
DictC = (Pair (',' Pair)* ','? | Stars | Pair For+ | Ex For+)?
Pair = Ex ':' Ex | '**' Or
For = 'async'? 'for' Goals 'in' Or ('if' Or | 'if' 'lambda' Ex)*
Args = (Ex For+ ','? | ArgP (',' ArgP)* (',' ArgK)* (',' ArgD)* ','? | ArgK (',' ArgK)* (',' ArgD)* ','? | ArgD (',' ArgD)* ','?)?
ArgP = '*'? Ex
ArgK = Id '=' Ex | '*' Ex
ArgD = Id '=' Ex | '**' Ex
Params = (Pos (',' Rest)? ','? | Rest ','?)?
Pos = Need (',' Need)* (',' '/' (',' Need)*)? (',' Have)* (',' '/' (',' Have)*)? | Have (',' Have)* (',' '/' (',' Have)*)?
Need = Id (':' Ex)?
Have = Need '=' Ex
Rest = '*' Id (':' Star)? (',' (Need | Have))* (',' '**' Need)? | '*' (',' (Need | Have))+ (',' '**' Need)? | '**' Need
Lead = Id (',' Id)* (',' '/' (',' Id)*)? (',' LHave)* (',' '/' (',' LHave)*)? | LHave (',' LHave)* (',' '/' (',' LHave)*)?
LHave = Id '=' Ex
LRest = '*' Id (',' (Id | LHave))* (',' '**' Id)? | '*' (',' (Id | LHave))+ (',' '**' Id)? | '**' Id
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? Id (':' Ex)? ('=' Star)?
Subs = Sub (',' Sub)* ','?
Sub = Ex? ':' Ex? (':' Ex?)? | Star
"""
_JS = """
File = Item*
Item = Import | Export | Stmt
Import = 'import' 's' With? End | 'import' 'type'? Clause 'from' 's' With? End
With = 'with' {:Object:}
Clause = Id (',' ({:Specs:} | '*' 'as' Id))? | {:Specs:} | '*' 'as' Id
Specs = (Spec (',' Spec)* ','?)?
Spec = 'type'? (Name | 's') ('as' (Name | 's'))?
Export = 'export' ('default' (Fun | Class | Expr End | INTERFACE) | Decl | 'type'? {:Specs:} ('from' 's' With?)? End | '*' ('as' Name)? 'from' 's' With? End | '=' Expr End)
End = ';' | 'NL'
Id = 'i' | 'asserts' | 'module' | 'from' | 'as' | 'of' | 'async' | 'get' | 'set' | 'static' | 'type' | 'namespace' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'is' | 'infer' | 'satisfies' | 'let' | 'acc' | 'interface' | 'implements'
Name = Id | 'with' | 'import' | 'export' | 'default' | 'function' | 'class' | 'extends' | 'const' | 'var' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'throw' | 'break' | 'continue' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'new' | 'in' | 'await' | 'yield' | 'this' | 'super' | 'typeof' | 'void' | 'instanceof' | 'pre' | 'enum' | 'debugger'
Block = Stmt*
Stmt = {:Block:} | ';' | 'NL' | Decl | Flow | Seq End
Decl = Fun | Class | Var End DECLS
Var = ('let' | 'var') Bind (',' Bind)* | 'const' Const (',' Const)*
Const = Target EXCL Ann '=' Expr
Bind = Target EXCL Ann ('=' Expr)?
Target = Id | {:Object:} | [:Elems:]
Flow = 'if' (:Seq:) Stmt ('else' Stmt)? | 'for' 'await'? (:ForHead:) Stmt | 'while' (:Seq:) Stmt | 'do' Stmt 'while' (:Seq:) End | 'return' Seq? End | 'throw' Seq End
 | 'break' Id? End | 'continue' Id? End | 'try' {:Block:} ('catch' (:Params:)? {:Block:} ('finally' {:Block:})? | 'finally' {:Block:}) | 'switch' (:Seq:) {:Cases:} | Id ':' Stmt | 'debugger' End WITHS
Cases = 'NL'* (('case' Seq | 'default') ':' Stmt*)*
ForHead = ('const' | 'let' | 'var')? Target Ann ('of' | 'in') Seq | Un ('of' | 'in') Seq | (Var | Seq)? ';' Seq? ';' Seq?
Seq = Expr (',' Expr)*
Expr = Cond | Left ('=' | 'asg') Expr | Arrow | 'yield' '*'? Expr?
Cond = Bin ('?' Expr ':' Expr)?
Bin = Un (BinOp Un)* CAST
BinOp = 'bin' | '+' | '-' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | 'in' | 'instanceof'
Un = ('pre' | '!' | '+' | '-' | 'inc' | 'typeof' | 'void' | 'await' | 'new')* Prim Post*
Left = 'new'* (Id | (:Seq:) | [:Elems:] | {:Object:} | 'this' | 'super' | 'import') Post* | ('s' | 't' | Fun | 'new' '.' Id) Post+
Prim = Id | 'n' | 's' | 't' | (:Seq:) | [:Elems:] | {:Object:} | Fun | Class | 'this' | 'super' | 'import' | 'new' '.' Id
Post = '.' Name | '?.' (Name | (:Args:) | [:Seq:]) | (:Args:) | [:Seq:] | 't' | 'inc' POSTS
Arrow = 'async'? (Id | TP? (:Params:) Ann) '=>' (Expr | {:Block:})
Fun = 'async'? 'function' '*'? Id? TP? (:Params:) Ann FBODY
Class = Deco* 'abstract'? 'class' Id? TP? HERITAGE {:Members:}
Deco = 'deco' (:Args:)? 'NL'*
Members = (Member | ';' | 'NL')*
Member = Deco* Mod* '*'? Key OPT TP? (:Params:) Ann MBODY | Deco* Mod* Key OPT Ann ('=' Expr)? End | 'static' {:Block:} MEMBERS
Mod = 'static' | 'async' | 'get' | 'set' MODS
Key = Name | 's' | 'n' | [:Seq:]
Object = 'NL'? (Prop (',' Prop)* ','?)? 'NL'?
Prop = '...' Expr | Key ':' Expr | Id ('=' Expr)? | ('async' | 'get' | 'set')? '*'? Key TP? (:Params:) Ann {:Block:}
Elems = Elem? (',' Elem?)*
Elem = '...'? Expr
Args = (Elem (',' Elem)* ','?)?
Params = (Par (',' Par)* ','?)?
Par = Deco* PMODS '...'? (Target | 'this') OPT Ann ('=' Expr)?
"""
_MODULE = (
    _JS.replace(" WITHS", "").replace(" | INTERFACE", "").replace(" DECLS", "").replace(" EXCL", "").replace(" CAST", "").replace(" POSTS", "").replace("FBODY", "{:Block:}").replace("HERITAGE", "('extends' Un)?")
    .replace("MBODY", "{:Block:}").replace(" MEMBERS", "").replace(" MODS", "").replace("PMODS ", "").replace(" OPT", "").replace(" Ann", "").replace(" TP?", "")
)


def _dialect_of(rules: str, mark: str, same: frozenset) -> str:
    """The rules with a mark behind the name of every nonterminal, but for those that are the same in all dialects."""
    names = {x.split(" = ")[0] for x in re.sub(r"\n\s*\|", " |", rules.strip()).split("\n")} - same
    marked = "|".join(sorted(names, key=len, reverse=True))
    return "\n".join(x for x in re.sub(rf"('[^']*')|\b({marked})\b", lambda m: m[1] or m[2] + mark, rules).split("\n") if x.split(" = ")[0] not in same)


# A script has no import and export declarations but the with statement; a module is the other way round.
_ALIKE = frozenset(("Id", "Name", "End", "Import", "Clause", "Specs", "Spec", "With", "Export"))
_SCRIPT = re.sub(r"(?m)^(Import|Export) = .*$", r"\1 = 'export' 'export' 'export'", _MODULE).replace("Item = Import | Export | Stmt", "Item = Stmt").replace("| 'debugger' End", "| 'debugger' End | 'with' (:Seq:) Stmt")
RULES["javascript"] = _MODULE + _dialect_of(_SCRIPT, "_s", _ALIKE)
RULES["typescript"] = (
    _JS.replace(" WITHS", "").replace("INTERFACE", "Interface").replace(" DECLS", " | Interface | 'type' Id TP? '=' Type End | 'const'? 'enum' Id {:Enums:} | 'declare' Decl | 'declare'? 'const' Bind (',' Bind)* End | 'declare'? ('namespace' | 'module') Id ('.' Id)* {:File:} | 'declare' ('module' 's' ({:File:} | End) | 'i' {:File:}) | 'declare'? 'async'? 'function' '*'? Id TP? (:Params:) Ann End")
    .replace("EXCL", "'!'?").replace(" CAST", " (('as' | 'satisfies') (Type | 'const') (BinOp Un)*)*").replace(" POSTS", " | '!' | TArgs (:Args:)").replace("FBODY", "{:Block:}")
    .replace("HERITAGE", "('extends' Un TArgs?)? ('implements' Types)?").replace("MBODY", "({:Block:} | End)").replace(" MEMBERS", " | Mod* [:Index:] Ann End").replace(" MODS", " | 'acc' | 'readonly' | 'abstract' | 'declare'")
    .replace("PMODS ", "('acc' | 'readonly')* ").replace("OPT", "('?' | '!')?")
    + """
Ann = (':' Type)?
Types = Type (',' Type)*
Type = '|'? TUnit (('|' | '&') TUnit)* ('extends' Type '?' Type ':' Type)? | 'asserts'? (Id | 'this') 'is' Type | 'asserts' (Id | 'this')
TUnit = ('keyof' | 'readonly' | 'typeof' | 'infer')* TPrim [:TIndex:]*
TPrim = Id ('.' Name)* TArgs? | 's' | 'n' | 't' | '-' 'n' | 'this' | 'void' | {:TMembers:} | [:TList:] | (:Type:) | 'new'? TP? (:Params:) '=>' Type | 'import' (:Type:) ('.' Name)* TArgs?
TIndex = Type?
TList = ('...'? (Id '?'? ':')? Type '?'? (',' '...'? (Id '?'? ':')? Type '?'?)* ','?)?
TArgs = '<' Type (',' Type)* '>'
TP = '<' TParam (',' TParam)* ','? '>'
TParam = 'const'? Id ('extends' Type)? ('=' Type)?
Index = Id ':' Type | Id 'in' Type ('as' Type)?
TMembers = (TMember | ';' | ',' | 'NL')*
TMember = ('readonly' | 'get' | 'set' | '-' | '+')* (Key '?'? (Ann | TP? (:Params:) Ann) | [:Index:] '?'? Ann) (';' | ',' | 'NL') | 'new'? TP? (:Params:) Ann (';' | ',' | 'NL')
Interface = 'interface' Id TP? ('extends' Types)? {:TMembers:}
Enums = 'NL'? (Key ('=' Expr)? (',' Key ('=' Expr)?)* ','?)? 'NL'?
"""
)
RULES["java"] = """
File = (Ann* 'package' Q ';')? (Import | ';')* (TypeDecl | ';')* | Import* Ann* 'i'? 'i' Q {:Any:}
Q = Id ('.' Id)*
Id = 'i' | 'record' | 'permits' | 'yield'
Import = 'import' 'static'? Q ('.' '*')? ';'
Ann = '@' Q (:AnnArgs:)?
AnnArgs = (AnnArg (',' AnnArg)*)?
AnnArg = (Id '=')? (Expr | {:Inits:} | Ann)
Mod = Ann | 'mod' | 'static' | 'default' | 'synchronized'
TypeDecl = Mod* (Class | Interface | Enum | Record)
Class = 'class' Id TP? ('extends' Type)? ('implements' Types)? ('permits' Types)? {:Members:}
Interface = ('interface' | '@interface') Id TP? ('extends' Types)? ('permits' Types)? {:Members:}
Enum = 'enum' Id ('implements' Types)? {:Enums:}
Record = 'record' Id TP? (:Params:) ('implements' Types)? {:Members:}
Enums = (Const (',' Const)* ','?)? (';' Member*)?
Const = Ann* Id (:Args:)? {:Members:}?
Members = Member*
Member = ';' | 'static'? {:Block:} | TypeDecl | Mod* TP? Type Id (:Params:) Dims Throws ({:Block:} | ('default' (Expr | {:Inits:} | Ann))? ';') | Mod* TP? Id (:Params:)? Throws {:Block:} | Mod* Type Vars ';'
Throws = ('throws' Types)?
Types = Type (',' Type)*
Type = Ann* Id TArgs? ('.' Id TArgs?)* Dims
Dims = [:Empty:]*
Empty =
TArgs = '<' (TArg (',' TArg)*)? '>'
TArg = Ann* '?' (('extends' | 'super') Type)? | Type
TP = '<' TParam (',' TParam)* '>'
TParam = Ann* Id ('extends' Type ('&' Type)*)?
Params = (Param (',' Param)*)?
Param = Mod* Type '...'? (Id | 'i' '.' 'i') Dims
Vars = Var (',' Var)*
Var = Id Dims ('=' (Expr | {:Inits:}))?
Inits = ((Expr | {:Inits:} | Ann) (',' (Expr | {:Inits:} | Ann))* ','?)?
Block = Stmt*
Stmt = {:Block:} | ';' | TypeDecl | Mod* Type Vars ';' | Flow | Does ';'
Does = Prim Post* ('=' | 'asg') Expr | 'inc' Un | Prim Post* ((:Args:) | 'inc') | 'new' New Post* | Switch
Flow = 'if' (:Expr:) Stmt ('else' Stmt)? | 'while' (:Expr:) Stmt | 'do' Stmt 'while' (:Expr:) ';' | 'for' (:ForHead:) Stmt | 'try' {:Block:} (Catch+ ('finally' {:Block:})? | 'finally' {:Block:})
 | 'try' (:Resources:) {:Block:} Catch* ('finally' {:Block:})? | Switch | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | Id ':' Stmt | 'synchronized' (:Expr:) {:Block:} | 'assert' Expr (':' Expr)? ';'
Catch = 'catch' (:CatchHead:) {:Block:}
CatchHead = Mod* Type ('|' Type)* Id
Resources = Resource (';' Resource)* ';'?
Resource = Mod* Type Id '=' Expr | Expr
ForHead = (Mod* Type Vars | Exprs)? ';' Expr? ';' Exprs? | Mod* Type Id ':' Expr
Exprs = Expr (',' Expr)*
Switch = 'switch' (:Expr:) {:Cases:}
Cases = (Label ':' Stmt* | Label '->' (Expr ';' | {:Block:} | 'throw' Expr ';'))*
Label = 'case' CaseItem (',' CaseItem)* ('i' Expr)? | 'default'
CaseItem = Cond | Type Id | 'default' | Id (:Pats:) Id?
Pats = (Pat (',' Pat)*)?
Pat = Mod* Type Id | Id (:Pats:)
Expr = Cond (('=' | 'asg') Expr)? | (Id | (:Params:) | (:Ids:)) '->' (Expr | {:Block:}) | Switch
Ids = (Id (',' Id)*)?
Cond = Bin ('?' Expr ':' Expr)?
Bin = Un (BinOp Un | 'instanceof' 'mod'? (Type Id? | Id (:Pats:)))*
BinOp = 'bin' | '+' | '-' | '*' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '='
Un = ('+' | '-' | '!' | '~' | 'inc' | (:Cast:))* Prim Post*
Cast = Type ('&' Type)*
Prim = Id | 'n' | 's' | (:Expr:) | 'super' | 'new' New | Id [:Empty:]+ | 'default' | (:Params:) '->' (Expr | {:Block:}) | (:Ids:) '->' (Expr | {:Block:}) | Id '->' (Expr | {:Block:}) | Id TArgs [:Empty:]* '::' ('new' | Id) | Switch
New = Ann* Id TArgs? ('.' Id TArgs?)* ((:Args:) {:Members:}? | [:Expr:]+ Dims | [:Empty:]+ {:Inits:})
Args = (Expr (',' Expr)*)?
Post = '.' (TArgs? Id | 'new' New | 'super' | 'class') | (:Args:) | [:Expr:] | 'inc' | '::' (Id | 'new')
"""
RULES["go"] = """
File = ('package' 'i' ';' | Import ';' | Top ';')*
Import = 'import' (ISpec | (:ISpecs:))
ISpecs = (ISpec ';')* ISpec?
ISpec = ('i' | '.')? 's'
Top = 'func' (:Params:)? 'i' [:TParams:]? (:Params:) Res? {:Block:}? | Decl
Decl = 'var' (VSpec | (:VSpecs:)) | 'const' (CSpec | (:CSpecs:)) | 'type' (TSpec | (:TSpecs:))
VSpecs = (VSpec ';')* VSpec?
VSpec = Ids (Type ('=' Exprs)? | '=' Exprs)
CSpecs = (CSpec ';')* CSpec?
CSpec = Ids (Type? '=' Exprs)?
TSpecs = (TSpec ';')* TSpec?
TSpec = 'i' [:TParams:]? '='? Type
Ids = 'i' (',' 'i')*
TParams = Ids Union (',' Ids Union)* ','?
Union = '~'? Type ('|' '~'? Type)*
Type = 'i' ('.' 'i')? [:TArgs:]? | '*' Type | [:Length:] Type | 'map' [:Type:] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' (:Params:) Res? | 'struct' {:Fields:} | 'interface' {:IMembers:} | (:Type:)
TArgs = Type (',' Type)* ','?
Length = (Expr | '...')?
Res = Type | (:Params:)
Params = (Par (',' Par)* ','?)?
Par = 'i' '...'? Type | '...'? Type
Fields = (Field ';')* Field?
Field = Ids Type 's'? | '*'? 'i' ('.' 'i')? [:TArgs:]? 's'?
IMembers = (IMember ';')* IMember?
IMember = 'i' (:Params:) Res? | Union
Block = (Stmt? ';')* Stmt?
Stmt = Decl | Simple | {:Block:} | If | For | 'switch' (Simple? ';')? Simple? {:Cases:} | 'select' {:Cases:} | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' 'i'? | 'continue' 'i'? | 'goto' 'i' | 'fallthrough' | 'i' ':' Stmt?
Simple = Exprs (('=' | ':=' | 'asg') Exprs)? | Expr 'inc' | Expr '<-' Expr
If = 'if' (Simple? ';')? Simple {:Block:} ('else' (If | {:Block:}))?
For = 'for' (Simple? | Simple? ';' Simple? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr) {:Block:}
Cases = (('case' (Args | Simple) | 'default') ':' (Stmt? ';')* Stmt?)*
Exprs = Expr (',' Expr)*
Expr = Un (Bin Un)*
Bin = 'bin' | '+' | '-' | '*' | '&' | '|' | '^'
Un = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Prim Post*
Prim = 'i' | 'n' | 's' | (:Inner:) | 'func' (:Params:) Res? {:Block:} | [:Length:] Type | 'map' [:Type:] Type | 'struct' {:Fields:} | 'chan' Type | 'interface' {:IMembers:}
Inner = Expr | Type
Post = '.' ('i' | (:TypeOf:)) | [:Index:] | (:Args:) | {:Lit:}
TypeOf = Type | 'type'
Index = Expr (',' Type)* | Expr? ':' Expr? (':' Expr)? | TArgs
Args = (Arg (',' Arg)* ','?)?
Arg = Expr '...'? | Type
Lit = (Elem (',' Elem)* ','?)?
Elem = Val (':' Val)?
Val = Expr | {:Lit:}
"""
RULES["rust"] = """
File = ('#' '!' [:Any:])* Item*
Item = Attr* Vis? Kind
Attr = '#' [:Any:]
Vis = 'pub' (:Any:)?
Kind = 'use' Use ';' | 'unsafe'? 'mod' Id (';' | {:File:}) | Fn | ('struct' | 'union') Id G? (Where? {:Fields:} | (:Tuple:) Where? ';' | Where? ';') | 'enum' Id G? Where? {:Variants:}
 | 'unsafe'? 'impl' G? 'const'? '!'? Type ('for' Type)? Where? {:Assoc:} | 'unsafe'? 'trait' Id G? (':' Bounds)? Where? {:Assoc:} | 'const' Id ':' Type ('=' Expr)? ';' | 'static' 'mut'? Id ':' Type ('=' Expr)? ';'
 | 'type' Id G? (':' Bounds)? Where? ('=' Type)? Where? ';' | 'unsafe'? 'extern' 's'? {:Assoc:} | 'extern' 'crate' Id ('as' Id)? ';' | 'macro_rules' '!' Id ({:Any:} | (:Any:) ';') | Path '!' ({:Any:} | (:Any:) ';' | [:Any:] ';')
Id = 'i' | 'union' | 'box' | 'macro_rules'
Use = ('::'? Seg0 ('::' Seg0)* ('::' (UseEnd))? | '::'? UseEnd) ('as' Id)?
UseEnd = '*' | {:Uses:}
Uses = (Use (',' Use)* ','?)?
Seg0 = Id | 'crate' | 'self' | 'super'
Fn = ('const' | 'async' | 'unsafe' | 'extern' 's'?)* 'fn' Id G? (:FnParams:) ('->' Type)? Where? ({:Block:} | ';')
FnParams = (FnParam (',' FnParam)* ','?)?
FnParam = Attr* (('&' 'life'?)? 'mut'? 'self' (':' Type)? | Pat ':' Type | '...' | Type)
G = '<' (GP (',' GP)* ','?)? '>'
GP = Attr* ('life' (':' Bounds)? | 'const' Id ':' Type ('=' Expr)? | Id (':' Bounds)? ('=' Type)?)
Bounds = (Bound ('+' Bound)* '+'?)?
Bound = '?'? ('for' G)? Type | 'life' | (:Bounds:)
Where = 'where' (WP (',' WP)* ','?)?
WP = ('for' G)? (Type | 'life') ':' Bounds
Type = ('&' | '&&') 'life'? 'mut'? Type | '*' ('const' | 'mut') Type | [:ArrayType:] | (:Types:) | ('unsafe' | 'extern' 's'?)* 'fn' (:FnParams:) ('->' Type)? | ('impl' | 'dyn') Bounds | TPath | '!' | Path '!' (:Any:)
ArrayType = Type (';' Expr)?
Types = (Type (',' Type)* ','?)?
TPath = '::'? TSeg ('::' TSeg)*
TSeg = Seg0 ('::'? GA | (:Types:) ('->' Type)?)? | '<' Type ('as' Type)? '>'
GA = '<' (GArg (',' GArg)* ','?)? '>'
GArg = Type | 'life' | '-'? 'n' | 's' | {:Block:} | Id GA? ('=' Type | ':' Bounds)
Path = '::'? PSeg ('::' (PSeg | GA))*
PSeg = Seg0 | '<' Type ('as' Type)? '>'
Fields = (Field (',' Field)* ','?)?
Field = Attr* Vis? Id ':' Type
Tuple = (TField (',' TField)* ','?)?
TField = Attr* Vis? Type
Variants = (Variant (',' Variant)* ','?)?
Variant = Attr* Id ({:Fields:} | (:Tuple:))? ('=' Expr)?
Assoc = ('#' '!' [:Any:])* Item*
Block = ('#' '!' [:Any:])* BStmt* Expr?
BStmt = ';' | Item | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' {:Block:})?)? ';' | Attr* Expr ';' | Attr* BlockEx | Path '!' {:Any:}
BlockEx = ('unsafe' | 'const')? {:Block:} | 'async' 'move'? {:Block:} | If | 'match' Expr {:Arms:} | ('life' ':')? ('loop' | 'while' Conds | 'for' Pat 'in' Expr) {:Block:} | 'life' ':' {:Block:}
If = 'if' Conds {:Block:} ('else' (If | {:Block:}))?
Conds = Cond0 ('&&' Cond0)*
Cond0 = 'let' Pat '=' Expr | Expr
Expr = Un (Bin Un)* ('..' | '..=')? | ('..' | '..=') Un? (Bin Un)*
Bin = 'bin' | '+' | '-' | '*' | '&' | '&&' | '|' | '||' | '<' | '>' | '>' '>' | '=' | 'asg' | '..' | '..=' | '>' '>' '='
Un = ('-' | '*' | '!' | '&' 'mut'? | '&&' 'mut'?)* Prim Post*
Prim = 'n' | 's' | Path {:Lit:}? | (:Exprs:) | [:Array:] | BlockEx | Closure | 'return' Expr? | 'break' 'life'? Expr? | 'continue' 'life'? | Path '!' ((:Any:) | [:Any:] | {:Any:})
Post = '.' (Id | 'n' | 'await') ('::' GA)? | (:Args:) | [:Expr:] | '?' | 'as' Type
Args = (Expr (',' Expr)* ','?)?
Exprs = (Expr (',' Expr)* ','?)?
Array = (Expr (',' Expr)* ','? | Expr ';' Expr)?
Closure = ('move' | 'async' | 'static')* ('|' (CPar (',' CPar)* ','?)? '|' | '||') ('->' Type)? Expr
CPar = PatAlt (':' Type)?
Lit = (LField (',' LField)* (',' '..' Expr)? ','? | '..' Expr)?
LField = Attr* (Id | 'n') (':' Expr)?
Arms = ('#' '!' [:Any:])* (Arm ','?)*
Arm = Attr* Pat ('if' Conds)? '=>' (Expr | BlockEx)
Pat = '|'? PatAlt ('|' PatAlt)*
PatAlt = ('&' | '&&') 'mut'? PatAlt | 'ref'? 'mut'? Id ('@' PatAlt)? | Path ((:Pats:) | {:FPats:})? | Val ('..=' Val | '..' Val? | '...' Val)? | '..' | '..=' Val | (:Pats:) | [:Pats:] | Path '!' (:Any:) | 'box' PatAlt
Val = '-'? 'n' | 's' | Path
Pats = (Pat (',' Pat)* ','?)?
FPats = (FPat (',' FPat)* ','?)?
FPat = Attr* ((Id | 'n') ':' Pat | 'ref'? 'mut'? Id | '..')
"""
_C = """
File = Ext*
Ext = ';' | Attr* Specs? FDeclr FnTail* BODY | Attr* Decl | 'i' (:Any:) ';' | 'extern' 's' ({:File:} | Ext) | 'asm' 'q'* (:Any:) ';' EXTS
Attr = [:Attrs:] | 'i' (:Any:)
Specs = Q* Core (Q | 'ty' | Attr)* | Q+
Q = 'q' | 'extern'
Core = 'ty' | Path | ('struct' | 'union') Attr* (Path {:Fields:}? | {:Fields:}) | 'enum' (Path {:Enums:}? | {:Enums:}) CORES
FDeclr = ('*' | 'q' PTRS)* (Path | (:Declr:)) Suffix* (:Params:)
Declr = ('*' | 'q' PTRS)* (Path | (:Declr:)) Suffix*
Suffix = (:Params:) | [:Size:]
InitD = Declr FnTail* (':' Cond)? ('=' Init INITS)?
Init = Expr | {:Inits:}
Inits = (InitE (',' InitE)* ','?)?
InitE = ('.' 'i' | [:Size:])* '='? Init
Decl = Specs (InitD (',' InitD)*)? ';'
FnTail = Attr TAILS
Params = (Par (',' Par)*)?
Par = Specs Abs? ('=' Expr)? | '...'
Abs = ('*' | 'q' PTRS)* (Path | (:Abs:) | '...' Path?)? Suffix*
Size = ('q'* Expr)?
Fields = (Ext ACCESS)*
Enums = (Enum (',' Enum)* ','?)?
Enum = 'i' ('=' Cond)?
Block = Stmt*
Stmt = {:Block:} | ';' | Decl | 'if' CE? (:Cond1:) Stmt ('else' Stmt)? | 'while' (:Cond1:) Stmt | 'do' Stmt 'while' (:Seq:) ';' | 'for' (:ForHead:) Stmt | 'switch' (:Cond1:) Stmt | 'case' Cond ('...' Cond)? ':' Stmt? | 'default' ':' Stmt? | 'i' ':' Stmt?
 | 'return' Init? ';' | 'break' ';' | 'continue' ';' | 'goto' 'i' ';' | 'asm' 'q'* (:Any:) ';' | Seq ';' STMTS
Cond1 = Seq | Specs InitD | Decl (Seq | Specs InitD)
ForHead = (Decl | Seq? ';') Seq? ';' Seq? FORS
Seq = Expr (',' Expr)*
Expr = Cond (('=' | 'asg') Init)?
Cond = Bin ('?' Seq? ':' Expr)?
Bin = Un (BinOp Un)*
BinOp = 'bin' | '+' | '-' | '*' | '&' | '&&' | '<' | '>' BINS
Un = ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | 'inc' | (:Cast:) | 'sizeof' UNS)* Prim Post*
Cast = Specs Abs?
Prim = Path | 'n' | 's'+ | ('s' | 'i')+ | (:Seq:) | 'sizeof' (:Cast:) | (:Cast:) {:Inits:} | (:StmtE:) | '_Generic' (:Generic:) PRIMS
StmtE = {:Block:}
Generic = Expr (',' (Cast | 'default') ':' Expr)+
Post = '.' Path | '->' Path | (:Args:) | [:Seq:] | 'inc' POSTS
Args = (Arg (',' Arg)*)?
Arg = Init | Cast ARGS
Attrs = [:Any:]
Path = 'i' PATHS
"""
RULES["c"] = (
    _C.replace("BODY", "{:Block:}").replace(" EXTS", "").replace(" CORES", "").replace(" PTRS", "").replace(" INITS", "").replace(" TAILS", "").replace(" ACCESS", "").replace(" CE?", "")
    .replace(" STMTS", "").replace(" FORS", "").replace(" BINS", "").replace(" UNS", "").replace(" PRIMS", "").replace(" POSTS", "").replace(" ARGS", "").replace(" PATHS", "")
)
RULES["cpp"] = (
    _C.replace("BODY", "(Ctor? {:Block:} | '=' ('default' | 'delete' | 'n') ';' | 'try' Ctor? {:Block:} Catch+)")
    .replace(" EXTS", " | Attr* Q* FDeclr FnTail* ';' | 'q'* 'namespace' Attr? Path? {:File:} | 'using' 'namespace'? 'typename'? Path ('=' Cast)? (',' Path)* ';' | 'namespace' 'i' '=' Path ';' | 'template' TP? Req? Ext | 'concept' 'i' '=' Cond ';' | 'static_assert' (:Args:) ';' | Access ':'")
    .replace(" CORES", " | ('struct' | 'union' | 'class') Attr* Path 'final'? (':' Base (',' Base)*)? {:Fields:} | 'class' Attr* (Path {:Fields:}? | {:Fields:}) | 'enum' ('struct' | 'class')? Path? (':' Specs)? ({:Enums:})? | 'typename' Path | 'decltype' (:Args:)")
    .replace("PTRS", "| '&' | '&&' | Path '::' '*'").replace(" INITS", " | {:Inits:} | (:Args:)").replace(" TAILS", " | 'q' | 'noexcept' (:Args:)? | 'override' | 'final' | '&' | '&&' | '->' Specs Abs? | 'requires' Cond | '=' ('default' | 'delete' | 'n')")
    .replace(" ACCESS", "").replace(" CE?", " 'q'?").replace(" STMTS", " | 'try' {:Block:} Catch+ | 'using' 'namespace'? 'typename'? Path ('=' Cast)? ';' | 'static_assert' (:Args:) ';' | 'co_return' Init? ';'")
    .replace(" FORS", " | (Decl)? Specs ('*' | '&' | '&&' | 'q')* ('i' | [:Ids:]) ':' Init").replace(" BINS", " | '>' '>' | '>' '='").replace(" UNS", " | 'throw' | 'co_await' | 'co_yield'")
    .replace(" PRIMS", " | 'this' | Path {:Inits:} | 'ty'+ ((:Args:) | {:Inits:}) | '::'? 'new' (:Args:)? (Cast | (:Cast:)) ((:Args:) | {:Inits:})? | '::'? 'delete' [:Size:]? Un | Lambda | 'throw' | 'noexcept' (:Args:) | 'typename' Path ((:Args:) | {:Inits:}) | 'decltype' (:Args:) | 'requires' (:Params:)? {:Any:} | (:Fold:)")
    .replace(" POSTS", " | '...' | {:Inits:}").replace(" ARGS", " | Init '...'").replace(" PATHS", " TArgs? ('::' PSeg)* | '::' PSeg ('::' PSeg)* | '~' 'i' | 'operator' Oper")
    + """
PSeg = 'template'? 'i' TArgs? | '~' 'i' | 'operator' Oper
Oper = 'bin' | '+' | '-' | '*' | '&' | '&&' | '<' | '>' | '>' '>' | '=' | '>' '=' | 'asg' | '!' | '~' | 'inc' | '->' | ',' | (:Empty:) | [:Empty:] | Cast | 'new' | 'delete' | 's' 'i'?
Empty =
TArgs = '<' (TArg (',' TArg)*)? '>'
TArg = Cast '...'? | Un (TBin Un)* '...'?
TBin = 'bin' | '+' | '-' | '*' | '&' | '&&'
TP = '<' (TPar (',' TPar)*)? '>'
TPar = ('typename' | 'class') '...'? 'i'? ('=' Cast)? | Par | 'template' TP ('typename' | 'class') 'i'?
Req = 'requires' Cond
Base = Access? 'q'? Access? Path '...'?
Access = 'public' | 'private' | 'protected'
Ctor = ':' Mem (',' Mem)*
Mem = Path ((:Args:) | {:Inits:}) '...'?
Catch = 'catch' (:Par:) {:Block:} | 'catch' (:Dots:) {:Block:}
Dots = '...'
Fold = Expr FoldOp '...' (FoldOp Expr)? | '...' FoldOp Expr
FoldOp = BinOp | ','
Ids = 'i' (',' 'i')*
Lambda = [:Caps:] TP? (:Params:)? FnTail* {:Block:}
Caps = (Cap (',' Cap)*)?
Cap = '&'? 'i' '...'? ('=' Expr)? | '&' | '=' | 'this' | '*' 'this'
"""
)

# Where a list of statements or members may be cut into parts that are recognised on their own: behind ';', a line end
# or a block, unless one of these goes on with the statement before. The lists are concatenations of such parts.
_LISTS = {
    "python": ("Suite", "File"),
    "javascript": ("Block", "File", "Members", "Block_s", "File_s", "Members_s"),
    "typescript": ("Block", "File", "Members", "TMembers"),
    "java": ("Block", "Members"),
    "go": ("Block", "File"),
    "rust": ("Assoc", "File", "Block"),
    "c": ("Block", "File", "Fields"),
    "cpp": ("Block", "File", "Fields"),
}
_CARRY_ON = {
    "python": "elif else except finally",
    "javascript": "else catch finally while ; = asg , . ?. ? : => + - * & | < > bin in instanceof inc NL as satisfies",
    "java": "else catch finally while ; = , . + - * & | < > bin ? : ) i",
    "c": "else while ; = , . catch i * & q ( [",
}
_CARRY_ON["typescript"] = _CARRY_ON["javascript"]
_CARRY_ON["cpp"] = _CARRY_ON["c"]
_CARRY_ON["rust"] = "else ; = , . ? :: + - * & && | || < > bin as => asg"
_CARRY_ON["go"] = "else ; = := , . + - * & | ^ bin : asg inc"


class Dialect:
    """One language: its lexer, its classes and its grammar, with a memory of the groups that were recognised."""

    memory = 150_000

    def __init__(self, name: str):
        self.name = name
        self.lexer = re.compile(LEXERS[name], re.M)
        self.classes: dict[str, str] = {}
        of: dict[str, str] = {}
        fresh = iter(range(0xE100, 0xF000))
        for line in _TOKENS[name].split("\n"):
            first, colon, rest = line.partition(":")
            if colon and first.isalnum() and rest and not rest.startswith(" ") or first == "+-":
                c = self.classes.setdefault(first, chr(next(fresh)))
                for t in rest.split():
                    of[t] = c
            else:
                for t in line.split():
                    if name == "c" and t in _CPP_ONLY and t != "::":
                        self.classes.setdefault(t, chr(next(fresh)))
                        continue
                    if t not in of:
                        of[t] = self.classes.setdefault(t, chr(next(fresh)))
        for t in ("i", "n", "s", "t", "life", "deco", "NL"):
            self.classes.setdefault(t, {"i": "i", "n": "n", "s": "s", "t": "t", "life": "l", "deco": "@", "NL": "\n"}[t])
        self.fixed = of
        self.grammar = Grammar(RULES[name], self.classes)
        self.of = _Classes(self)
        self.lists = _LISTS[name]
        keep = [self.classes[t] for t in _CARRY_ON[name].split() if t in self.classes]
        self.carry_on = frozenset(keep)
        self.known: dict[tuple[str, str], str] = {}
        self.parts: dict[tuple[str, str], bool | set[str]] = {}
        self.semicolon = self.classes.get(";", "\0")
        self.inner = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
        if name in ("javascript", "typescript"):
            c = self.classes
            ends = "inst@)]}" + "".join(c[x] for x in "inc this super return break continue from as of async get set static type let yield default debugger ! acc".split() if x in c) + (c[">"] if name == "typescript" else "")
            starts = "inst@([{}" + "".join(
                c[x] for x in "import export default from as function class const let var if for while do return throw break continue try switch case new of async await yield get set static this super typeof void pre inc ! * acc type interface enum namespace declare abstract readonly debugger ...".split() if x in c
            )
            self.no_line_end = re.compile(f"(?<![{re.escape(ends)}])\n+|\n+(?![{re.escape(starts)}\n])")
        elif name == "go":
            c = self.classes
            ends = "ins)]}" + "".join(c[x] for x in "break continue fallthrough return inc".split())
            self.line_end = re.compile(f"(?<=[{re.escape(ends)}])\n\n*")
        # runs of literals in a list: its length does not matter
        comma = self.classes[","]
        minus = self.classes.get("-", self.classes.get("+-", "\0"))
        self.literals = re.compile(f"((?:{re.escape(minus)}?[ns]{re.escape(comma)})(?:\n?))(?:(?:{re.escape(minus)}?[ns]{re.escape(comma)})\n?){{3,}}")

    def recognises(self, text: str) -> bool:
        """Whether the language's grammar derives the text."""
        if text.startswith("#!") and not text.startswith("#![") and self.name in ("javascript", "typescript", "rust"):
            text = text[text.find("\n") + 1 or len(text) :]
        if self.name == "python":
            return self._python(text)
        s = "".join(map(self.of.__getitem__, self.lexer.findall(text) if self.name not in ("rust", "cpp") else [m[0] for m in self.lexer.finditer(text)]))
        if self.name in ("javascript", "typescript"):
            s = self.no_line_end.sub("", s) + "\n"
        elif self.name == "go":
            s = self.line_end.sub(self.semicolon, s + "\n").replace("\n", "")
        s = self._reduced(s)
        if s is None or (self.name == "go" and not self._in_order(s)):
            return False
        return self._any_dialect(s)

    def _any_dialect(self, s: str) -> bool:
        """Whether one of the dialects derives the file: all run over one stack, part by part, as long as they hold."""
        alive = [x for x in ("File", "File_s") if x in self.grammar.names]
        for part in self._cut(s) or [s]:
            key = "any of " + " ".join(alive), part
            known = self.parts.get(key)
            if known is None:
                if len(self.parts) > self.memory:
                    self.parts.clear()
                known = self.parts[key] = self.grammar.derived(part, alive)
            alive = [x for x in alive if x in known]
            if not alive:
                return False
        return True

    def _in_order(self, s: str) -> bool:
        """Go: one package clause, then imports, then the rest."""
        package, imports = self.classes["package"], self.classes["import"]
        heads = [p[0] for p in self._cut(s)]
        body = [h != imports for h in heads[1:]]
        return bool(heads) and heads[0] == package and package not in heads[1:] and body == sorted(body)

    def _reduced(self, s: str) -> str | None:
        if "\0" in s:
            return None
        s = self.literals.sub(r"\1", s)
        while True:
            t, n = self.inner.subn(self._group, s)
            if not n:
                break
            s = t
        return None if any(c in s for c in "()[]{}") else s

    def _group(self, m: re.Match) -> str:
        kind = m[0][0]
        content = m[0][1:-1]
        if kind != "{" and "\n" in content:
            content = content.replace("\n", "")
        key = kind, content
        c = self.known.get(key)
        if c is None:
            names = self.grammar.held[kind]
            whole = [x for x in names if x not in self.lists and x != "Any"]
            found = self.grammar.derived(content, whole) if whole else set()
            found |= {x for x in names if x in self.lists and self._holds(x, content)}
            # a last statement may end with its block
            if kind == "{" and "NL" in self.classes and self.name in ("javascript", "typescript") and content and content[-1] not in "\n":
                ended = content + "\n"
                found |= {x for x in names if x.removesuffix("_s") in ("File", "Block", "Members", "Cases", "TMembers") and x not in found and self._holds(x, ended)}
            if "Any" in names:
                found.add("Any")
            if len(self.known) > self.memory:
                self.known.clear()
            c = self.known[key] = self.grammar.group(kind, found)
        return c

    def _holds(self, name: str, s: str) -> bool:
        """Whether the nonterminal derives s; lists part by part."""
        if name not in self.lists:
            return self._part(name, s)
        return all(self._part(name, p) for p in self._cut(s)) if s else self._part(name, s)

    def _part(self, name: str, s: str) -> bool:
        key = name, s
        known = self.parts.get(key)
        if known is None:
            if len(self.parts) > self.memory:
                self.parts.clear()
            known = self.parts[key] = name in self.grammar.derived(s, [name])
        return known

    def _cut(self, s: str) -> list[str]:
        out, a = [], 0
        groups, carry = self.grammar.groups, self.carry_on
        ends = ("\n",) if self.name == "python" else (self.semicolon, "\n")
        n = len(s)
        # Go's headers hold semicolons: there, a statement with one ends behind its block only
        heads = {self.classes[x] for x in ("if", "for", "switch")} if self.name == "go" else frozenset()
        at = self.classes.get("@", "\0") if self.name == "python" else "\0"
        line = 0
        for i, c in enumerate(s):
            if c in ends or (c in groups and self._closes(c)):
                # a decorator belongs to what follows
                decorator, line = s[line] == at, i + 1
                if decorator:
                    continue
                if heads and not (s[i - 1] in groups and any(k == "{" for k, _ in groups[s[i - 1]])) and not heads.isdisjoint(s[a:i]):
                    continue
                after = s[i + 1] if i + 1 < n else ""
                if after and (after in carry or after in groups):
                    continue
                out.append(s[a : i + 1])
                a = i + 1
        if a < n:
            out.append(s[a:])
        return out

    def _closes(self, c: str) -> bool:
        """Whether a statement may end with this group; with line ends as tokens, only a Python suite ends one."""
        kind = "<" if self.name == "python" else "\0" if "javascript" in (self.name, self.name.replace("type", "java")) else "{"
        return any(k == kind for k, _ in self.grammar.groups[c])

    def _python(self, text: str) -> bool:
        widths: dict[str, tuple[int, int]] = {}
        chars: dict[str, str] = {}
        of = self.of
        out = []
        for t in self.lexer.findall(text):
            if t[0] == "\n":
                c = chars.get(t)
                if c is None:
                    c = chars[t] = chr(0x40000 + len(chars))
                    blank = t[1:].rpartition("\f")[2]
                    tabs = 0
                    for x in blank:
                        tabs = (tabs // 8 + 1) * 8 if x == "\t" else tabs + 1
                    widths[c] = (tabs, len(blank))
                out.append(c)
            else:
                out.append(of[t])
        s = "".join(out)
        lead = re.match(r"[ \t\f]*", text)[0]
        breaks = "".join(widths) or ""
        strip = re.compile(f"[{re.escape(breaks)}]")
        if "\0" in s:
            return False

        def group(m: re.Match) -> str:
            kind, content = m[0][0], strip.sub("", m[0][1:-1])
            return self._group(re.match(r"[\s\S]*", kind + content + ")"))

        s = self.literals.sub(r"\1", s)
        while True:
            t, n = self.inner.subn(group, s)
            if not n:
                break
            s = t
        if any(c in s for c in "()[]{}"):
            return False
        # logical lines and their indentation
        stack = [(0, 0)]
        blocks: list[list[str]] = [[]]
        pieces = re.split(f"([{re.escape(breaks)}])", s)
        indent = (len(lead.expandtabs(8)), len(lead))
        for k in range(0, len(pieces), 2):
            line = pieces[k]
            if k:
                indent = widths[pieces[k - 1]]
            if not line:
                continue
            top = stack[-1]
            if indent[0] > top[0]:
                if indent[1] <= top[1] or not blocks[-1] or len(stack) > 100:
                    return False
                stack.append(indent)
                blocks.append([])
            elif indent != top:
                while stack and stack[-1][0] > indent[0]:
                    stack.pop()
                    if not self._close(blocks):
                        return False
                if not stack or stack[-1] != indent:
                    return False
            blocks[-1].append(line + "\n")
        while len(blocks) > 1:
            if not self._close(blocks):
                return False
        return self._any_dialect("".join(blocks[0]))

    def _close(self, blocks: list[list[str]]) -> bool:
        content = "".join(blocks.pop())
        key = "<", content
        c = self.known.get(key)
        if c is None:
            found = {x for x in self.grammar.held["<"] if self._holds(x, content)}
            if len(self.known) > self.memory:
                self.known.clear()
            c = self.known[key] = self.grammar.group("<", found)
        if not self.grammar.groups[c]:
            return False
        blocks[-1].append(c)
        return True


class _Classes(dict):
    """Token -> class character, learnt as tokens come."""

    def __init__(self, dialect: Dialect):
        super().__init__(dialect.fixed)
        self.dialect = dialect
        for c in "()[]{}\n":
            self[c] = c

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            fixed = dict(self.dialect.fixed)
            self.clear()
            self.update(fixed)
            for c in "()[]{}\n":
                self[c] = c
        v = self[t] = self._of(t)
        return v

    def _of(self, t: str) -> str:
        c, name = t[0], self.dialect.name
        python = name == "python"
        if python and t == "...":
            return "i"
        if t.startswith(("//", "/*")) and not python and len(t) > 1:
            return ""
        if c == "#" and len(t) > 1 and name in ("c", "cpp") or c == "#" and python:
            return ""
        if c in " \t" and name in ("c", "cpp"):
            return ""
        if c == "\\" and python and len(t) > 1:
            return ""
        if name in ("javascript", "typescript"):
            if len(t) > 2 and "/" in t and c not in "\"'`" and not t[-1].isspace():
                head = re.match(r"=>|&&|\|\||[=!]==?|[(,=:\[!&|?;{}+]|return|case|typeof", t)
                if head and t[head.end() :].lstrip().startswith("/"):
                    return self[head[0]] + "s"
            if c == "`":
                return "t" if len(t) > 1 else "\0"
            if c == "@" and len(t) > 1:
                return "@"
            if c == "#" and len(t) > 1 or c == "$":
                return "i"
        if name == "go" and c == "`":
            return "s" if len(t) > 1 else "\0"
        if name == "rust" and c == "'" and not t.endswith("'"):
            return "l" if len(t) > 1 else "\0"
        if python and t[-1] in "\"'" and "f" in t[:2].lower().partition("'")[0].partition('"')[0] and not fields_close(t):
            return "\0"
        if t[-1] in "\"'" and len(t) > 1 or name == "rust" and t.endswith("#") and '"' in t:
            return "s"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "\0" if python and _OCTAL.fullmatch(t) else "n"
        if c.isalpha() or c == "_" or c == "$":
            return "i"
        return "\0"


_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*")


def fields_close(token: str) -> bool:
    """Whether the fields of a formatted string are closed and not empty."""
    quote = token.lstrip("fFrRtT")[:3]
    quote = quote if len(set(quote)) == 1 and len(quote) == 3 and len(token) > 5 else quote[0]
    body = token[token.index(quote) + len(quote) : -len(quote)]
    depth, i, n = 0, 0, len(body)
    while i < n:
        c = body[i]
        if not depth and body[i : i + 2] in ("{{", "}}"):
            i += 1
        elif c == "{":
            depth += 1
            if body[i + 1 :].lstrip()[:1] in ("}", ""):
                return False
        elif c == "}":
            if not depth:
                return False
            depth -= 1
        elif c == "\\" and not depth:
            i = body.find("}", i) % n if body[i + 1 : i + 3] == "N{" else i + 1
        elif depth and c in "\"'":
            close = body.find(c, i + 1)
            i = close if close >= 0 else i
        i += 1
    return not depth


@cache
def dialect(name: str) -> Dialect:
    return Dialect(name)
