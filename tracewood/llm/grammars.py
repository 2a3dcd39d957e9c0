"""Grammars of the languages that rule files name, in the notation of ``peg``.

They accept what the languages' own grammars accept up to points that need names or types (a label's target, whether a
name is a type); operator precedence is left out, as it decides about meaning and not about form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from tracewood.extract import lexing
from tracewood.extract.lexing import Tokens
from tracewood.llm.peg import Grammar

PYTHON = r"""
file <- (stmt / NL)* EOF
stmt <- compound / simple
simple <- small (";" small)* ";"? NL
block <- NL INDENT (stmt / NL)+ DEDENT / simple
small <- "pass" / "break" / "continue" / "return" stars? / "raise" (test ("from" test)?)? / ("global" / "nonlocal") name ("," name)* / "del" stars
       / "assert" test ("," test)? / import / alias / yield / assignment
import <- "import" dotted ("as" name)? ("," dotted ("as" name)?)* / "from" ("." / "...")* dotted? "import" ("*" / "(" names ","? ")" / names)
names <- name ("as" name)? ("," name ("as" name)?)*
dotted <- name ("." name)*
alias <- "type" name tparams? "=" test
assignment <- (places "=")+ value / place ":" test ("=" value)? / place augmented value / stars !("=" / ":" / augmented)
places <- ("*"? place) ("," "*"? place)* ","?
place <- atom (trailer &("." / "(" / "["))* ("." name / "[" subscripts "]") / name / "(" places? ")" / "[" places? "]"
augmented <~ "+=" / "-=" / "*=" / "/=" / "//=" / "%=" / "@=" / "&=" / "|=" / "^=" / ">>=" / "<<=" / "**="
value <- yield / stars
yield <- "yield" ("from" test / stars?)
compound <- if / while / for / try / with / def / class / decorated / match / "async" (def / for / with)
if <- "if" named ":" block ("elif" named ":" block)* ("else" ":" block)?
while <- "while" named ":" block ("else" ":" block)?
for <- "for" targets "in" stars ":" block ("else" ":" block)?
try <- "try" ":" block (("except" "*"? (stars ("as" name)?)? ":" block)+ ("else" ":" block)? ("finally" ":" block)? / "finally" ":" block)
with <- "with" ("(" withitem ("," withitem)* ","? ")" &":" / withitem ("," withitem)*) ":" block
withitem <- test ("as" target)?
def <- "def" name tparams? "(" params? ")" ("->" test)? ":" block
class <- "class" name tparams? ("(" args? ")")? ":" block
decorated <- ("@" named NL)+ (def / class / "async" def)
match <- "match" stars ":" NL INDENT ("case" patterns ("if" named)? ":" block)+ DEDENT
patterns <- pattern ("," pattern)* ","?
pattern <- orpattern ("as" name)? / "*" name
orpattern <- closed ("|" closed)*
closed <- "-"? NUM (("+" / "-") NUM)? / string / "None" / "True" / "False" / "(" patterns? ")" / "[" patterns? "]" / "{" ((mapped ("," mapped)*) ","?)? "}" / dotted ("(" (argpattern ("," argpattern)* ","?)? ")")?
mapped <- "**" name / closed ":" pattern
argpattern <- (name "=")? pattern
tparams <- "[" tparam ("," tparam)* ","? "]"
tparam <- ("*" / "**")? name (":" test)? ("=" test)?
params <- param ("," param)* ","?
param <- "/" / ("*" / "**") name (":" ("*")? test)? / "*" / name (":" test)? ("=" test)?
lparams <- lparam ("," lparam)* ","?
lparam <- "/" / ("*" / "**") name / "*" / name ("=" test)?
targets <- target ("," target)* ","?
target <- "*"? primary
stars <- star ("," star)* ","?
star <- "*" binary / named
named <- name ":=" test / test
test <- "lambda" lparams? ":" test / binary ("if" binary "else" test)?
binary <- unary (operator unary)*
operator <~ "or" / "and" / "not" "in" / "in" / "is" "not"? / "<" / ">" / "==" / ">=" / "<=" / "!=" / "|" / "^" / "&" / "<<" / ">>" / "+" / "-" / "*" / "/" / "//" / "%" / "@" / "**"
unary <- ("not" / "-" / "+" / "~" / "await")* primary
primary <- atom trailer*
trailer <- "." name / "(" args? ")" / "[" subscripts "]"
args <- arg ("," arg)* ("," keyword)* ("," last)* ","? / keyword ("," keyword)* ("," last)* ","? / last ("," last)* ","?
arg <- "*" test / !(name "=") named comp?
keyword <- name "=" test / "*" test
last <- name "=" test / "**" test
subscripts <- subscript ("," subscript)* ","?
subscript <- test? ":" test? (":" test?)? / star
atom <- name / NUM / string / "(" (yield / stars comp?)? ")" / "[" (stars comp?)? "]" / "{" (dict / stars comp?)? "}" / "..." / "None" / "True" / "False"
dict <- pair (comp / ("," pair)* ","?)
pair <- "**" binary / test ":" test
comp <- ("async"? "for" targets "in" binary ("if" (name ":=" test / binary))*)+
string <- (STR / fstring)+
fstring <- FBEG field* FEND
field <- FOPEN (yield / stars) "="? FCONV? (FSPEC field* FCLOSE / FCLOSE)
name <~ ID / "match" / "case" / "type" / "_"
"""

_SCRIPT = r"""
file <- stmt* EOF
stmt <- block / variables / function / class / if / for / while / do / switch / try / import / export / label / ";" / "return" (@same expr)? semi / "throw" @same expr semi
      / ("break" / "continue") (@same ident)? semi / "debugger" semi / "with" "(" expr ")" stmt / TYPED expression
expression <- !("{" / "function" / "class") expr semi
block <- "{" stmt* "}"
semi <- ";" / &"}" / &EOF / @nl
variables <- ("var" / "const" / "let" &(ident / "{" / "[")) binding ("," binding)* semi
binding <- bindtarget BANG TYPE ("=" assign)?
bindtarget <- ident / array / object
function <- "async"? "function" "*"? ident TPARAMS params RTYPE (block SIGNATURE)
class <- decorator* ABSTRACT "class" (!("extends" / "implements") ident)? TPARAMS ("extends" heritage)? IMPLEMENTS "{" member* "}"
heritage <- postfix TARGS
decorator <- "@" postfix
member <- ";" / "static" block / decorator* (modifier &memberstart)* (("get" / "set") &propname)? "*"? propname OPTIONAL (TPARAMS params RTYPE (block SIGNATURE) / TYPE ("=" assign)? semi) MEMBERS
memberstart <- propname / "*"
propname <- anyname / STR / NUM / "[" assign "]" / PRIV
params <- "(" (param ("," param)* ","?)? ")"
param <- decorator* PARAMMODS "..."? (bindtarget / THIS) OPTIONAL TYPE ("=" assign)?
if <- "if" "(" expr ")" stmt ("else" stmt)?
while <- "while" "(" expr ")" stmt
do <- "do" stmt "while" "(" expr ")" ";"?
for <- "for" "await"? "(" (("var" / "let" / "const") bindtarget TYPE ("of" / "in") expr / unary "of" assign / unary "in" expr / (("var" / "let" / "const") binding ("," binding)* / expr)? ";" expr? ";" expr?) ")" stmt
switch <- "switch" "(" expr ")" "{" (("case" expr / "default") ":" stmt*)* "}"
try <- "try" block ("catch" ("(" bindtarget TYPE ")")? block ("finally" block)? / "finally" block)
label <- ident ":" stmt
import <- "import" !("(" / ".") (STR / importclause "from" STR) (("with" / "assert") object)? semi
importclause <- TYPEONLY (ident ("," (namespaced / list))? / namespaced / list)
namespaced <- "*" "as" ident
list <- "{" (item ("," item)* ","?)? "}"
item <- TYPEONLY (anyname / STR) ("as" (anyname / STR))?
export <- "export" ("default" (defaultfunction / class / assign semi) / TYPEONLY ("*" ("as" anyname)? "from" STR semi / list ("from" STR)? semi) / variables / function / class EXPORTED)
defaultfunction <- "async"? "function" "*"? ident? TPARAMS params RTYPE block
expr <- assign ("," assign)*
assign <- arrow / "yield" ("*" assign / @same assign)? / conditional (assignop assign)?
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "**=" / "<<=" / "&=" / "|=" / "^=" / "&&=" / "||=" / "??=" / ">" ">="  / ">" ">" ">="
conditional <- binary ("?" assign ":" assign)?
binary <- unary (binop unary ASTYPE)*
binop <~ ">" ">"* / "||" / "&&" / "??" / "|" / "^" / "&" / "==" / "!=" / "===" / "!==" / "<" / "<=" / ">=" / "instanceof" / "in" / "<<" / "+" / "-" / "*" / "/" / "%" / "**"
unary <- (("!" / "~" / "+" / "-" / "++" / "--" / "typeof" / "void" / "delete") unary / "await" unary / postfix (@same ("++" / "--"))?) ASTYPE
postfix <- primary suffix*
suffix <- "." (anyname / PRIV) / "?." (anyname / "[" expr "]" / args / PRIV) / "[" expr "]" / args / template SUFFIXES
args <- "(" (element ("," element)* ","?)? ")"
element <- "..."? assign
primary <- "async"? "function" "*"? ident? TPARAMS params RTYPE block / ident / NUM / STR / REGEX / template / array / object / "(" expr ")" / class / new / "this" / "super" / "null" / "true" / "false" / "import" (args / "." anyname) / PRIV
new <- "new" ("." ident / target TARGS args?)
target <- (new / !"new" primary) ("." (anyname / PRIV) / "[" expr "]")*
array <- "[" ","* (element (","+ element)* ","*)? "]"
object <- "{" (property ("," property)* ","?)? "}"
property <- "..." assign / ("async" @same &(propname / "*"))? ("*" / ("get" / "set") &propname)? propname TPARAMS params RTYPE block / propname ":" assign / ident ("=" assign)?
arrow <- "async"? @same (ident "=>" / TPARAMS params RTYPE @same "=>") (block / assign) / ident "=>" (block / assign) / TPARAMS params RTYPE "=>" (block / assign)
template <- TEMPLATE / THEAD expr (TMID expr)* TTAIL
ident <~ ID / "async" / "await" / "from" / "as" / "get" / "set" / "of" / "static" / "let" / "yield" WORDS
modifier <~ "static" / "async" MODIFIERS
anyname <~ ID / "async" / "await" / "break" / "case" / "catch" / "class" / "const" / "continue" / "debugger" / "default" / "delete" / "do" / "else" / "export" / "extends" / "finally" / "for" / "function" / "get" / "if" / "import" / "in" / "instanceof" / "let" / "new" / "of" / "return" / "set" / "static" / "super" / "switch" / "this" / "throw" / "try" / "typeof" / "var" / "void" / "while" / "with" / "yield" / "null" / "true" / "false" / "from" / "as" NAMES
"""
_TS_WORDS = '/ "abstract" / "any" / "asserts" / "declare" / "infer" / "interface" / "is" / "keyof" / "module" / "namespace" / "private" / "protected" / "public" / "readonly" / "satisfies" / "type" / "unique" / "override" / "implements" / "accessor"'
_HOLES = {
    "TYPED": ("", 'declaration /'), "BANG": ("", '"!"?'), "TYPE": ("", "(\":\" type)?"), "RTYPE": ("", "(\":\" returned)?"), "TPARAMS": ("", "tparams?"), "SIGNATURE": ("", "/ semi"), "ABSTRACT": ("", '"abstract"?'),
    "IMPLEMENTS": ("", '("implements" type ("," type)*)?'), "TARGS": ("", "targs?"), "OPTIONAL": ("", '("?" / "!")?'), "MEMBERS": ("", '/ (modifier &"[")* "[" ident ":" type "]" ":" type semi'), "PARAMMODS": ("", "(modifier &(bindtarget / modifier))*"),
    "TYPEONLY": ("", '("type" &("{" / "*" / ident !("from" STR / ",") / ident "from" STR))?'), "EXPORTED": ("", '/ declaration / "=" expr semi / "as" "namespace" ident semi'), "ASTYPE": ("", '(@same ("as" / "satisfies") ("const" / type))*'), "SUFFIXES": ("", '/ @same "!" !"=" / targs (args / template)'),
    "THIS": ("bindtarget", '"this"'), "WORDS": ("", _TS_WORDS), "MODIFIERS": ("", '/ "public" / "private" / "protected" / "readonly" / "abstract" / "declare" / "override" / "accessor"'), "NAMES": ("", _TS_WORDS + ' / "enum"'),
}
_TYPES = r"""
declaration <- interface / typealias / enum / namespace / "declare" @same (declared / "global" block) / class
declared <- variables / function / class / interface / typealias / enum / namespace
interface <- "interface" ident tparams? ("extends" type ("," type)*)? objecttype
typealias <- "type" @same ident tparams? "=" type semi
enum <- "const"? "enum" ident "{" (propname ("=" assign)? ("," propname ("=" assign)?)* ","?)? "}"
namespace <- ("namespace" / "module") @same (ident ("." ident)* / STR) (block / semi)
tparams <- "<" tparam ("," tparam)* ","? ">"
tparam <- ("const" / "in" / "out")? ident ("extends" type)? ("=" type)?
targs <- "<" type ("," type)* ","? ">"
returned <- "asserts"? (ident / "this") "is" type / "asserts" ident / type
type <- functiontype / union ("extends" union "?" type ":" type)?
functiontype <- "abstract"? "new"? tparams? params "=>" returned
union <- ("|" / "&")? modified (("|" / "&") modified)*
modified <- ("keyof" / "readonly" / "unique" / "infer") modified / array_type
array_type <- basic (@same "[" type? "]")*
basic <- "(" type ")" / mapped / objecttype / tuple / STR / "-"? NUM / typetemplate / "void" / "null" / "this" / "true" / "false" / "typeof" ("import" args / entity) targs? / "import" args ("." anyname)* targs? / entity (@same targs)?
entity <- ident ("." anyname)*
typetemplate <- TEMPLATE / THEAD type (TMID type)* TTAIL
tuple <- "[" (tupleitem ("," tupleitem)* ","?)? "]"
tupleitem <- "..."? (ident "?"? ":" type / type "?"?)
objecttype <- "{" (typemember (";" / "," / &"}" / @nl))* "}"
mapped <- "{" (("+" / "-")? "readonly")? "[" ident "in" type ("as" type)? "]" (("+" / "-")? "?")? (":" type)? ";"? "}"
typemember <- ("readonly" &(propname / "["))? ("[" ident ":" type "]" ":" type / (("get" / "set") &propname)? propname "?"? (tparams? params (":" returned)? / (":" type)?) / "new"? tparams? params (":" returned)?)
"""


def _script(typed: bool) -> str:
    text = _SCRIPT
    for hole, options in sorted(_HOLES.items(), key=lambda x: -len(x[0])):
        text = re.sub(rf"\b{hole}\b", lambda _, o=options[typed]: o, text)
    return text + (_TYPES if typed else "")


JAVA = r"""
file <- package? (import / ";")* (typedecl / ";")* EOF
package <- annotation* "package" qualified ";"
import <- "import" "static"? qualified ("." "*")? ";"
qualified <- ident ("." ident)*
typedecl <- modifiers declared
modifiers <- (annotation / !(("sealed" / "record" / "non") !(modword / "class" / "interface" / "@" / "-")) modword)*
modword <~ "public" / "private" / "protected" / "static" / "final" / "abstract" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default" / "sealed" / "non" "-" "sealed"
annotation <- "@" !"interface" qualified ("(" (pairs / annvalue)? ")")?
pairs <- ident "=" annvalue ("," ident "=" annvalue)*
annvalue <- annotation / "{" (annvalue ("," annvalue)* ","?)? "}" / conditional
declared <- class / interface / enum / record / "@" "interface" ident classbody
class <- "class" ident tparams? ("extends" type)? ("implements" types)? ("permits" types)? classbody
interface <- "interface" ident tparams? ("extends" types)? ("permits" types)? classbody
record <- "record" ident tparams? "(" (recordpart ("," recordpart)*)? ")" ("implements" types)? classbody
recordpart <- annotation* type "..."? ident
enum <- "enum" ident ("implements" types)? "{" (constant ("," constant)*)? ","? (";" member*)? "}"
constant <- annotation* ident args? classbody?
classbody <- "{" member* "}"
member <- ";" / "static"? block / modifiers (declared / method / field)
method <- tparams? (annotation* type ident / ident) (params dims? ("throws" types)? ("default" annvalue)? (block / ";") / &"{" block)
field <- type declarator ("," declarator)* ";"
declarator <- ident dims? ("=" init)?
init <- arrayinit / expr
arrayinit <- "{" (init ("," init)* ","?)? "}"
dims <- (annotation* "[" "]")+
params <- "(" (param ("," param)* ","?)? ")"
param <- ("final" / annotation)* type (annotation* "...")? (ident dims? / (ident ".")? "this")
types <- type ("," type)*
type <- annotation* (primitive / classtype) (annotation* "[" "]")*
classtype <- ident targs? ("." annotation* ident targs?)*
primitive <~ "int" / "long" / "byte" / "short" / "char" / "boolean" / "float" / "double" / "void"
targs <- "<" (targ ("," targ)*)? ">"
targ <- annotation* ("?" (("extends" / "super") type)? / type)
tparams <- "<" tparam ("," tparam)* ">"
tparam <- annotation* ident ("extends" type ("&" type)*)?
block <- "{" stmt* "}"
stmt <- block / ";" / if / for / while / "do" stmt "while" "(" expr ")" ";" / switch / try / "return" expr? ";" / "throw" expr ";" / ("break" / "continue") ident? ";" / "assert" expr (":" expr)? ";" / "synchronized" "(" expr ")" block
      / "yield" !("=" / "." / "(" ")") expr ";" / ident ":" stmt / modifiers declared / local ";" / effect ";"
effect <- &("(" / "new" / "this" / "super" / "++" / "--" / "switch" / IDENTS / STR / "int" / "long" / "char" / "byte" / "short" / "boolean" / "float" / "double") expr
local <- ("final" / annotation)* type declarator ("," declarator)*
if <- "if" "(" expr ")" stmt ("else" stmt)?
while <- "while" "(" expr ")" stmt
for <- "for" "(" (("final" / annotation)* type ident ":" expr / (local / expr ("," expr)*)? ";" expr? ";" (expr ("," expr)*)?) ")" stmt
switch <- "switch" "(" expr ")" "{" (case (":" stmt* / "->" (block / "throw" expr ";" / expr ";")))* "}"
case <- "case" caselabel ("," caselabel)* ("when" expr)? / "default"
caselabel <- "default" / pattern !("->" / ":" / ",") &"when" / pattern &("->" / ":" / "when" / ",") / conditional
pattern <- ("final" / annotation)* type (ident / "(" (pattern ("," pattern)*)? ")" ident?)
try <- "try" ("(" resource (";" resource)* ";"? ")" block catches? / block catches)
catches <- ("catch" "(" ("final" / annotation)* type ("|" type)* ident ")" block)+ ("finally" block)? / "finally" block
resource <- ("final" / annotation)* type ident "=" expr / expr
expr <- lambda / conditional (assignop expr)?
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">=" / ">" ">" ">="
lambda <- (ident / "(" (ident ("," ident)* / param ("," param)*)? ")") "->" (block / expr)
conditional <- binary ("?" expr ":" (lambda / conditional))?
binary <- unary ("instanceof" ("final"? pattern / type) / binop unary)*
binop <~ ">" ">"* / "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<" / "<=" / ">=" / "<<" / "+" / "-" / "*" / "/" / "%"
unary <- ("+" / "-" / "++" / "--" / "!" / "~") unary / cast / postfix
cast <- "(" primitive dims? ("&" type)* ")" (lambda / unary) / "(" type ("&" type)* ")" &(IDENTS / NUM / STR / TEXT / CHAR / "(" / "!" / "~" / "this" / "super" / "new" / "true" / "false" / "null" / "switch" / "int" / "long" / "char" / "byte" / "short" / "boolean" / "float" / "double" / "void") (lambda / unary)
postfix <- primary suffix* ("++" / "--")*
suffix <- "." ("new" creator / targs? (ident / "super") args? / "class" / "this") / "[" expr "]" / "::" targs? (ident / "new")
primary <- NUM / STR / TEXT / CHAR / "true" / "false" / "null" / switch / "this" args? / "super" args? / "new" creator / "(" expr ")" / primitive dims? ("." "class" / "::" "new") / classtype dims? "::" targs? (ident / "new") / classtype dims "." "class" / ident args?
creator <- annotation* targs? (primitive / classtype) (args classbody? / (annotation* "[" expr "]")+ dims? / dims arrayinit)
args <- "(" (expr ("," expr)*)? ")"
ident <~ ID / "record" / "sealed" / "permits" / "yield" / "when" / "non"
"""
JAVA = JAVA.replace("IDENTS", 'ID / "record" / "sealed" / "permits" / "yield" / "when"')

C = r"""
file <- external* EOF
external <- ";" / "extern" STR ("{" external* "}" / external) / asm ";" / assertion / function / declaration / ID args ";"?
function <- specifiers fdeclarator (attribute / asm)* declaration* block
fdeclarator <- ("*" qualifier*)* (ID / "(" attribute* declarator ")") attribute* params (params / "[" (assign / "*")? "]" / attribute)*
declaration <- "__extension__"? specifiers (initial ("," initial)*)? ";" / assertion
assertion <- ("_Static_assert" / "static_assert") "(" conditional ("," STR+)? ")" ";"
specifiers <- qualifier* (core qualifier* (core qualifier*)* / ID qualifier*) / qualifier+ &("*" / ID / "(")
qualifier <- "const" / "volatile" / "restrict" / "__restrict" / "static" / "extern" / "typedef" / "auto" / "register" / "inline" / "__inline" / "_Noreturn" / "_Thread_local" / "_Atomic" / ("_Alignas" / "alignas") "(" (typename / conditional) ")" / attribute
core <- "void" / "char" / "short" / "int" / "long" / "float" / "double" / "signed" / "unsigned" / "_Bool" / "bool" / "_Complex" / ("struct" / "union") attribute* (ID ("{" structmember* "}")? / "{" structmember* "}") attribute*
      / "enum" attribute* (ID enumbody? / enumbody) / ("typeof" / "__typeof__") "(" (typename / expr) ")"
structmember <- ";" / assertion / specifiers ((declarator? ":" conditional / declarator) attribute* ("," (declarator? ":" conditional / declarator))*)? ";"
enumbody <- "{" enumerator ("," enumerator)* ","? "}"
enumerator <- ID attribute* ("=" conditional)?
attribute <- "__attribute__" "(" "(" balanced* ")" ")" / "[" "[" balanced* "]" "]"
asm <- ("asm" / "__asm__") qualifier* "(" balanced* ")"
balanced <- "(" balanced* ")" / "[" balanced* "]" / "{" balanced* "}" / !("(" / ")" / "[" / "]" / "{" / "}") .
initial <- declarator (asm / attribute)* ("=" initializer)?
initializer <- "{" (designated ("," designated)* ","?)? "}" / assign
designated <- (("[" conditional ("..." conditional)? "]" / "." ID)+ "=" / ID ":")? initializer
declarator <- ("*" qualifier* / "^")* direct
direct <- (ID / "(" attribute* declarator ")") (params / "[" ("static" / "const" / "restrict")* (assign / "*")? "]" / attribute)*
params <- "(" (param ("," param)* ("," "...")? / "...")? ")"
param <- specifiers (declarator / abstract)? attribute*
abstract <- ("*" qualifier*)+ tail? / tail
tail <- ("(" abstract ")" ("[" assign? "]" / params)* / ("[" ("static" / "const")* (assign / "*")? "]" / params)+)
typename <- specifiers abstract?
block <- "{" stmt* "}"
stmt <- block / ";" / if / "for" "(" (declaration / expr? ";") expr? ";" expr? ")" stmt / "while" "(" expr ")" stmt / "do" stmt "while" "(" expr ")" ";" / "switch" "(" expr ")" stmt / "case" conditional ("..." conditional)? ":" labelled / "default" ":" labelled
      / "return" expr? ";" / "break" ";" / "continue" ";" / "goto" "*"? (ID / unary) ";" / asm ";" / attribute ";" / ID ":" attribute? labelled / expr ";" / declaration
labelled <- stmt / &"}"
if <- "if" "(" expr ")" stmt ("else" stmt)?
expr <- assign ("," assign)*
assign <- conditional (assignop (initializer))?
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">>="
conditional <- binary ("?" expr? ":" conditional)?
binary <- unary (binop unary)*
binop <~ "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<" / ">" / "<=" / ">=" / "<<" / ">>" / "+" / "-" / "*" / "/" / "%"
unary <- ("++" / "--" / "&" / "*" / "+" / "-" / "~" / "!" / "&&") unary / ("sizeof" / "_Alignof" / "alignof") (sized / unary) / cast / postfix
sized <- "(" typename ")" !"{"
cast <- "(" typename ")" &(ID / NUM / STR / CHAR / "(" / "~" / "!" / "{" / "sizeof") (initlist / unary) / "(" coretype ")" unary / "__extension__" unary
coretype <- qualifier* core qualifier* (core qualifier*)* abstract? / qualifier* ID qualifier* ("*" qualifier*)+
initlist <- "{" (designated ("," designated)* ","?)? "}" suffix*
postfix <- primary suffix*
suffix <- "[" expr "]" / args / ("." / "->") ID / "++" / "--"
args <- "(" (argument ("," argument)*)? ")"
argument <- assign / typename
primary <- ID STR+ (ID STR*)* / ID / NUM / (STR ID?)+ / CHAR / "(" block ")" / "(" expr ")"
"""

GO = r"""
file <- "package" ID ";" (import ";")* (decl ";"+ / ";")* EOF
import <- "import" (importspec / "(" ";"* (importspec ";")* importspec? ")")
importspec <- ("." / "_" / ID)? STR
decl <- group / func
group <- ("const" / "var") (spec / "(" ";"* (spec ";"+)* spec? ")") / "type" (typespec / "(" ";"* (typespec ";"+)* typespec? ")")
spec <- ID ("," ID)* (type ("=" exprs)? / "=" exprs)?
typespec <- ID (tparams type / "="? type)
tparams <- "[" tparam ("," tparam)* ","? "]"
tparam <- ID ("," ID)* constraint
constraint <- "~"? type ("|" "~"? type)*
func <- "func" params? ID tparams? signature block?
signature <- params (params / type)?
params <- "(" (param ("," param)* ","?)? ")"
param <- ID "..."? type / "..."? type
type <- "*" type / "[" "]" type / "[" ("..." / expr) "]" type / "map" "[" type "]" type / "chan" "<-"? type / "<-" "chan" type / "func" signature / struct / interface / "(" type ")" / ID ("." ID)? targs?
targs <- "[" type ("," type)* ","? "]"
struct <- "struct" "{" ";"* (field ";"+)* field? "}"
field <- (ID ("," ID)* type / "*"? ID ("." ID)? targs?) STR?
interface <- "interface" "{" ";"* (method ";"+)* method? "}"
method <- ID signature / constraint
block <- "{" stmts "}"
stmts <- (stmt? ";")* stmt?
stmt <- group / block / if / for / switch / select / "return" exprs? / ("break" / "continue" / "goto") ID? / "fallthrough" / ("defer" / "go") expr / ID ":" stmt? / simple
simple <- exprs ((":=" / assignop) exprs / "++" / "--" / "<-" expr)?
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">>=" / "&^="
head <- hexprs ((":=" / assignop) hexprs / "++" / "--" / "<-" hexpr)?
if <- "if" (head? ";")? hexpr block ("else" (if / block))?
for <- "for" (block / (exprs (":=" / "="))? "range" hexpr block / head? ";" hexpr? ";" head? block / hexpr block)
switch <- "switch" (head? ";")? head? "{" clause* "}"
clause <- ("case" arg ("," arg)* / "default") ":" stmts
select <- "select" "{" (("case" simple / "default") ":" stmts)* "}"
exprs <- expr ("," expr)*
expr <- unary (binop unary)*
binop <~ "||" / "&&" / "==" / "!=" / "<" / "<=" / ">" / ">=" / "+" / "-" / "|" / "^" / "*" / "/" / "%" / "<<" / ">>" / "&" / "&^"
unary <- ("+" / "-" / "!" / "^" / "*" / "&" / "<-" !"chan") unary / operand suffix*
suffix <- "." (ID / "(" (type / "type") ")") / "[" (expr? ":" expr? (":" expr)? / arg ("," arg)* ","?) "]" / args
args <- "(" (arg ("," arg)* "..."? ","?)? ")"
arg <- expr &("," / ")" / "]" / "..." / ":" / ";") / type
operand <- NUM / STR / CHAR / "func" signature block / literal / "(" expr ")" / ID / "(" type ")" / conversion
conversion <- ("[" "]" type / "map" "[" type "]" type / "chan" type / "interface" "{" "}" / "func" signature / "*" type) &"("
literal <- (ID ("." ID)? targs? / "[" "..."? expr? "]" type / "map" "[" type "]" type / struct) elements
elements <- "{" (keyed ("," keyed)* ","?)? "}"
keyed <- (elements / expr) (":" (elements / expr))?
hexprs <- hexpr ("," hexpr)*
hexpr <- hunary (binop hunary)*
hunary <- ("+" / "-" / "!" / "^" / "*" / "&" / "<-") hunary / hoperand suffix*
hoperand <- NUM / STR / CHAR / "func" signature block / ("[" "..."? expr? "]" type / "map" "[" type "]" type / struct) elements / "(" expr ")" / ID / "(" type ")" / conversion
"""

RUST = r"""
file <- inner* item* EOF
inner <- "#" "!" "[" tree* "]"
outer <- "#" "[" tree* "]"
tree <- "(" tree* ")" / "[" tree* "]" / "{" tree* "}" / !("(" / ")" / "[" / "]" / "{" / "}") .
item <- outer* (macro_item / vis? (function / struct / enum / implementation / trait / module / use / constant / alias / extern))
vis <- "pub" ("(" ("crate" / "self" / "super" / "in" path) ")")?
function <- ("const" / "async" / "unsafe" / "extern" STR?)* "fn" ID generics? "(" (param ("," param)* ","?)? ")" ("->" type)? where? (block / ";")
param <- outer* ("&" LIFE? "mut"? "self" / "mut"? "self" (":" type)? / "..." / pattern ":" ("..." / type) / type)
struct <- ("struct" / "union" &ID) ID generics? (where? "{" (named ("," named)* ","?)? "}" / "(" (outer* vis? type ("," outer* vis? type)* ","?)? ")" where? ";" / where? ";")
union_name <- "union"
named <- outer* vis? ID ":" type
enum <- "enum" ID generics? where? "{" (variant ("," variant)* ","?)? "}"
variant <- outer* vis? ID ("{" (named ("," named)* ","?)? "}" / "(" (outer* vis? type ("," outer* vis? type)* ","?)? ")")? ("=" expr)?
implementation <- ("default" / "unsafe")* "impl" generics? "const"? "!"? type ("for" type)? where? "{" inner* member* "}"
trait <- "unsafe"? "trait" ID generics? (":" bounds?)? where? "{" inner* member* "}"
member <- outer* (macro_item / vis? (function / constant / alias))
module <- "unsafe"? "mod" ID (";" / "{" inner* item* "}")
use <- "use" usetree ";"
usetree <- "::"? (usepart "::")* ("*" / "{" (usetree ("," usetree)* ","?)? "}" / usepart ("as" (ID / "_"))?)
usepart <~ ID / "self" / "super" / "crate" / "Self" / "union"
constant <- ("const" / "static" "mut"?) (ID / "_") (":" type)? ("=" expr)? ";"
alias <- "type" ID generics? (":" bounds)? where? ("=" type)? where? ";"
extern <- "extern" "crate" (ID / "self") ("as" (ID / "_"))? ";" / "unsafe"? "extern" STR? "{" inner* member* "}"
macro_item <- "macro_rules" "!" ID delimited ";"? / path "!" ID? delimited ";"?
delimited <- "(" tree* ")" / "[" tree* "]" / "{" tree* "}"
generics <- "<" (generic ("," generic)* ","?)? ">"
generic <- outer* (LIFE (":" (LIFE ("+" LIFE)*)?)? / "const" ID ":" type ("=" (block / "-"? NUM / ID))? / ID (":" bounds?)? ("=" type)?)
where <- "where" (predicate ("," predicate)* ","?)?
predicate <- LIFE ":" (LIFE ("+" LIFE)*)? / forall? type ":" bounds?
forall <- "for" generics
bounds <- bound ("+" bound)* "+"?
bound <- LIFE / "(" bound ")" / "?"? forall? ("~" "const")? typepath
type <- "&" LIFE? "mut"? type / "&&" LIFE? "mut"? type / "*" ("const" / "mut") type / "[" type (";" expr)? "]" / "(" (type ("," type)* ","?)? ")" / forall? ("unsafe" / "extern" STR?)* "fn" "(" (fnarg ("," fnarg)* ","?)? ")" ("->" type)?
      / ("dyn" / "impl") bounds / "!" / "_" / forall typepath / typepath ("!" delimited)? / qualified
fnarg <- outer* ((ID / "_") ":")? ("..." / type)
qualified <- "<" type ("as" typepath)? ">" ("::" segment)+
typepath <- "::"? typesegment ("::" typesegment)*
typesegment <- name ("::"? targs / "::"? "(" (type ("," type)* ","?)? ")" ("->" type)?)?
targs <- "<" (targ ("," targ)* ","?)? ">"
targ <- LIFE / ID targs? "=" type / ID targs? ":" bounds / type &("," / ">") / block / "-"? NUM / STR / CHAR / "true" / "false"
name <~ ID / "self" / "Self" / "super" / "crate" / "union"
path <- "::"? name ("::" segment)*
segment <- name ("::" targs)? / targs
block <- "{" inner* (stmt)* expr? "}"
stmt <- ";" / let / outer* blockexpr ";"? !suffix_after / statement_item / outer* expr ";"
suffix_after <~ "." / "?"
statement_item <- !(("unsafe" / "const" / "async") "{" / path "!" / "union" / "const" "|" / "async" ("move" / "|")) item / path "!" "{" tree* "}" !("." / "?") ";"? / "macro_rules" "!" ID delimited ";"?
let <- outer* "let" pattern (":" type)? ("=" expr ("else" block)?)? ";"
expr <- range
range <- ("..=" / "..") binary? / binary ((".." / "..=") binary?)? (assignop expr)?
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">="
binary <- unary (binop unary / "as" type)*
binop <~ ">" ">"? / "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<" / "<=" / ">=" / "<<" / "+" / "-" / "*" / "/" / "%"
unary <- ("-" / "!" / "*" / ("&" / "&&") ("raw" / "mut")?) unary / postfix
postfix <- primary suffix*
suffix <- "?" / "." (ID ("::" targs)? args? / NUM / "await" / "union") / args / "[" expr "]"
args <- "(" (outer* expr ("," outer* expr)* ","?)? ")"
primary <- NUM / STR / CHAR / "true" / "false" / blockexpr / "(" (expr ("," expr)* ","?)? ")" / "[" (expr (";" expr / ("," expr)* ","?))? "]" / "return" expr? / "break" LIFE? expr? / "continue" LIFE? / "yield" expr? / closure / path "!" delimited / structure / valuepath
closure <- ("static" / "async" / "move" / "const")* ("||" / "|" (cparam ("," cparam)* ","?)? "|") ("->" type block / expr)
cparam <- outer* single (":" type)?
valuepath <- qualified / path / "_"
structure <- path "{" (fieldinit ("," fieldinit)*)? ","? (".." expr?)? "}"
fieldinit <- outer* ((ID / NUM) (":" expr)?)
blockexpr <- (LIFE ":")? ("loop" block / "while" condition block / "for" pattern "in" hexpr block / block) / ("unsafe" / "const" / "async" "move"?) block / if / match
if <- "if" condition block ("else" (if / block))?
condition <- conditionpart ("&&" conditionpart)*
conditionpart <- "let" pattern "=" hunary_chain / hexpr_noand
match <- "match" hexpr "{" inner* (arm)* "}"
arm <- outer* pattern ("if" (condition)) ? "=>" (blockexpr ","? !suffix_after / expr (","/ &"}"))
hexpr <- hrange
hrange <- ("..=" / "..") hbinary? / hbinary ((".." / "..=") hbinary?)? (assignop hexpr)?
hbinary <- hunary (binop hunary / "as" type)*
hexpr_noand <- hrange
hunary_chain <- hunary (!"&&" binop hunary / "as" type)*
hunary <- ("-" / "!" / "*" / ("&" / "&&") "mut"?) hunary / hprimary suffix*
hprimary <- NUM / STR / CHAR / "true" / "false" / blockexpr / "(" (expr ("," expr)* ","?)? ")" / "[" (expr (";" expr / ("," expr)* ","?))? "]" / "return" hexpr? / "break" LIFE? / "continue" LIFE? / closure / path "!" delimited / valuepath
pattern <- "|"? single ("|" single)*
single <- ("&" / "&&") "mut"? single / "ref"? "mut"? ID !("::" / "(" / "{" / "!" / ".." / "..=") ("@" single)? / "_" / ".." !patlit / (qualified / path) ("(" (pattern ("," pattern)* ","?)? ")" / "{" (patfield ("," patfield)* ","?)? "}") / path "!" delimited / patlit (("..=" / ".." / "...") patlit?)? / ("..=" / "..") patlit / qualified / "const" block / "(" (pattern ("," pattern)* ","?)? ")" / "[" (pattern ("," pattern)* ","?)? "]"
patlit <- "-"? NUM / STR / CHAR / "true" / "false" / path
patfield <- outer* (".." / (ID / NUM) ":" pattern / "ref"? "mut"? ID)
"""

RUBY = r"""
file <- stmts EOF
stmts <- sep* (stmt (sep+ / &closing))*
closing <~ "end" / EOF / ")" / "}" / "else" / "elsif" / "when" / "in" / "rescue" / "ensure" / "then" / "do" / LOOPDO
sep <~ NL / ";"
stmt <- "alias" (ID / SYM / IVAR / CONST) (ID / SYM / IVAR / CONST) modifier* / "undef" (ID / SYM / CONST) ("," NL? (ID / SYM / CONST))* modifier* / ("BEGIN" / "END") "{" stmts "}" / statement modifier*
modifier <- ("if" / "unless" / "while" / "until" / "rescue") statement
statement <- negated (("and" / "or") NL? negated)*
negated <- "not" negated / multiple / command / expr
multiple <- target ("," NL? target)+ ","? "=" NL? values / "*" target ("," target)* "=" NL? values / target "," "=" values
target <- "*"? (postfix / "(" target ("," target)* ")")
values <- value ("," NL? value)*
value <- "*"? expr
command <- !"defined?" (receiver / "!"? head) @gap &argstart arguments doblock? chain*
receiver <- "!"? primary (!lastcall suffix)* lastcall @gap &argstart
chain <- NL? ("." / "&.") (method arguments0? brace? doblock?)
arguments0 <- "(" callargs? ")"
head <- "yield" / "super" / "return" / "break" / "next" / ID !"=" / CONST &(STR / SYM / NUM / LABEL / CONST / ID / IVAR)
lastcall <- ("." / "&.") NL? method !("(" / "." / "&." / "=" / "[")
argstart <- ID / CONST / STR / SYM / NUM / LABEL / IVAR / REGEX / "self" / "nil" / "true" / "false" / "not" / "->" / "::" CONST / "defined?" / "lambda" / "proc" / "if" _never / "case" / "begin" / "def" / "super" / "yield" / "__method__" / "__FILE__" / "__LINE__" / "!" !"=" / "[" / ("*" / "&" / "**" / "-" / ":") &tightvalue / "..." / "(" / "while" _never / "class" _never
_never <~ !. EOF
tightvalue <- @glued .
arguments <- argument ("," NL? argument)*
argument <- LABEL NL? (command / expr)? / ("*" / "**" / "&") expr? / "..." / command / pairexpr
pairexpr <- expr (NL? "=>" NL? (command / expr))?
callargs <- NL* callarg (NL* "," NL* callarg)* (NL* ",")? NL*
callarg <- LABEL NL* (command / expr)? / ("*" / "**" / "&") expr? / "..." / command / stmtexpr (NL* "=>" NL* expr)?
stmtexpr <- expr
expr <- unary_not / ternary (assignop NL? (command / values_or_expr) ("rescue" expr)?)?
unary_not <- "not" expr
values_or_expr <- expr ("," NL? value)* / "*" expr ("," NL? value)*
assignop <~ "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "**=" / "||=" / "&&=" / "|=" / "&=" / "^=" / "<<=" / ">>="
ternary <- binary ("?" NL? ternary_part NL? ":" NL? ternary / "?" NL? LABEL NL? ternary)?
ternary_part <- expr
binary <- unary (binop NL* unary_or_cmd)* (".." / "...")?
unary_or_cmd <- unary
binop <~ "||" / "&&" / "<=>" / "==" / "===" / "!=" / "=~" / "!~" / "<" / "<=" / ">" / ">=" / "|" / "^" / "&" / "<<" / ">>" / "+" / "-" / "*" / "/" / "%" / "**" / ".." / "..."
unary <- ("!" / "-" / "+" / "~" / "&" / ".." / "...") unary / "defined?" unary / postfix
postfix <- primary suffix*
suffix <- NL? ("." / "&.") NL? (method arguments0? brace? doblock? / "(" callargs? ")") / "::" (CONST arguments0? / ID arguments0? brace? doblock?) / @glued "[" callargs? "]" / brace_after / do_after
brace_after <- _never
do_after <- _never
method <~ ID / CONST / "class" / "self" / "end" / "`" / "+" / "-" / "*" / "/" / "==" / "!" / "<<" / "[" "]" / "%" / "<" / ">" / "<=" / ">=" / "<=>"
brace <- "{" blockparams? stmts "}"
doblock <- "do" blockparams? body "end"
blockparams <- "|" (param ("," NL? param)* ","?)? (";" ID ("," ID)*)? "|" / "||"
body <- stmts ("rescue" rescued? ("then" / sep) stmts)* ("else" stmts)? ("ensure" stmts)?
rescued <- (exprlist)? ("=>" postfix)?
exprlist <- value ("," NL? value)*
primary <- literal / "(" stmts ")" / array / hash / if / unless / while / case / for / begin / def / class / module / lambda / keyword / call
literal <- NUM / STR+ / SYM / REGEX / IVAR / "nil" / "true" / "false" / "self" / "__FILE__" / "__LINE__" / "__method__"
array <- "[" callargs? NL* "]"
hash <- "{" NL* (pair (NL* "," NL* pair)* (NL* ",")?)? NL* "}"
pair <- LABEL NL* (expr)? / "**" expr / expr NL* "=>" NL* expr
call <- (ID arguments0? / CONST (@glued arguments0)? / "::" CONST) brace? doblock?
keyword <- ("yield" / "super") (@glued arguments0)? brace? doblock? / ("return" / "break" / "next") (!("if" / "unless") value ("," value)*)? / "redo" / "retry"
then <~ sep* "then" / sep+
if <- "if" statement then stmts ("elsif" statement then stmts)* ("else" stmts)? "end"
unless <- "unless" statement then stmts ("else" stmts)? "end"
while <- ("while" / "until") statement (LOOPDO / sep) stmts "end"
for <- "for" target ("," target)* "in" statement (LOOPDO / sep) stmts "end"
case <- "case" statement? sep* (("when" exprlist then stmts)+ / ("in" pattern (("if" / "unless") statement)? then stmts)+) ("else" stmts)? "end"
pattern <- patternitem ("," NL? patternitem)* ","?
patternitem <- LABEL patternalt? / "*" ID? / "**" (ID / "nil")? / patternalt
patternalt <- patternprim ("|" patternprim)* ("=>" ID)?
patternprim <- "[" (NL* pattern)? NL* "]" / "{" (NL* pattern)? NL* "}" / "^" (ID / IVAR / "(" expr ")") / "nil" / CONST ("::" CONST)* ("(" pattern? ")" / "[" pattern? "]")? / (".." / "...") unary / literal ((".." / "...") unary?)? / "-" NUM / ID / "->" lambda_body
begin <- "begin" body "end"
def <- "def" defname ("(" NL* (param (NL* "," NL* param)* (NL* ",")?)? NL* ")" / params)? ("=" NL? (command / expr) / sep body "end" / &("end") "end")
defname <- ("self" "." / CONST "." / ID ".")? (defop / (ID / CONST / "ID") (@glued "=" &("(" / ID))?)
defop <~ "+" "@"? / "-" "@"? / "*" / "/" / "%" / "**" / "==" / "===" / "=~" / "!" / "<=>" / "<" / "<=" / ">" / ">=" / "<<" / ">>" / "[" "]" "="? / "&" / "|" / "^" / "~" / "`" / "!=" / "self"
params <- param ("," NL? param)*
param <- "*" ID? / "**" (ID / "nil")? / "&" ID? / "..." / LABEL (!("," / ")" / NL / "|") ternary)? / ID ("=" ternary_nopipe)? / "(" param ("," param)* ")"
ternary_nopipe <- unary (binop_nopipe unary)*
binop_nopipe <~ "||" / "&&" / "==" / "<" / ">" / "+" / "-" / "*" / "/" / "%" / ".." / "<<"
class <- "class" ("<<" expr / ("::")? CONST ("::" CONST)* ("<" expr)?) sep body "end"
module <- "module" ("::")? CONST ("::" CONST)* sep body "end"
lambda <- "->" lambda_body
lambda_body <- ("(" (param ("," NL? param)*)? (";" ID ("," ID)*)? ")" / params)? ("{" stmts "}" / "do" body "end")
"""

LUA = r"""
file <- block EOF
block <- stmt* ("return" (expr ("," expr)*)? ";"?)?
stmt <- ";" / "break" / "goto" ID / "::" ID "::" / "do" block "end" / "while" expr "do" block "end" / "repeat" block "until" expr / if / for / "function" ID ("." ID)* (":" ID)? funcbody / "local" "function" ID funcbody / "local" ID attrib ("," ID attrib)* ("=" expr ("," expr)*)? / assignment
attrib <- ("<" ID ">")?
if <- "if" expr "then" block ("elseif" expr "then" block)* ("else" block)? "end"
for <- "for" (ID "=" expr "," expr ("," expr)? / ID ("," ID)* "in" expr ("," expr)*) "do" block "end"
assignment <- suffixed ("," suffixed)* "=" expr ("," expr)* / callonly
callonly <- primary (!(call !suffixstart) suffix)* call
suffixstart <~ "." / "[" / ":" / "(" / "{" / STR
suffixed <- primary suffix*
primary <- ID / "(" expr ")"
suffix <- "." ID / "[" expr "]" / call
call <- (":" ID)? ("(" (expr ("," expr)*)? ")" / table / STR)
funcbody <- "(" ((ID / "...") ("," (ID / "..."))*)? ")" block "end"
expr <- unary (binop unary)*
binop <~ "or" / "and" / "<" / ">" / "<=" / ">=" / "~=" / "==" / "|" / "~" / "&" / "<<" / ">>" / ".." / "+" / "-" / "*" / "/" / "//" / "%" / "^"
unary <- ("not" / "#" / "-" / "~") unary / "nil" / "false" / "true" / NUM / STR / "..." / "function" funcbody / table / suffixed
table <- "{" (field ((";" / ",") field)* (";" / ",")?)? "}"
field <- "[" expr "]" "=" expr / ID "=" expr / expr
"""

KOTLIN = r"""
file <- ("@" ID ":" (annotation1 / "[" annotation1+ "]"))* ("package" dotted semi)? ("import" dotted ("." "*")? ("as" ident)? semi)* (declaration semi)* EOF
semi <- ";"+ / @nl / &EOF / &"}"
dotted <- ident ("." ident)*
annotation <- "@" (ID ":")? annotation1 / "@" (ID ":")? "[" annotation1+ "]"
annotation1 <- usertype args?
modifiers <- (annotation / modifier !("=" / "." / "(" / ":" / ")" / ","))*
modifier <~ "public" / "private" / "internal" / "protected" / "open" / "abstract" / "final" / "sealed" / "data" / "enum" / "annotation" / "inner" / "companion" / "override" / "lateinit" / "inline" / "noinline" / "crossinline" / "reified" / "suspend" / "operator" / "infix" / "tailrec" / "external" / "const" / "vararg" / "out" / "in" / "expect" / "actual" / "value"
declaration <- modifiers (class / object / function / property / alias)
class <- ("class" / "fun"? "interface") ident tparams? (modifiers "constructor"? "(" (classparam ("," classparam)* ","?)? ")")? (":" supers)? constraints? classbody?
classparam <- modifiers ("val" / "var")? ident ":" type ("=" expr)?
supers <- super ("," super)*
super <- annotation* usertype args? ("by" expr)?
classbody <- "{" ((enumentry ("," enumentry)* ","?)? ";")? enumtail? (member semi?)* "}"
enumtail <- enumentry ("," enumentry)* ","?
enumentry <- modifiers ident args? classbody? &("," / ";" / "}")
member <- "init" block / modifiers "constructor" params (":" ("this" / "super") args)? block? / "companion" "object" ident? (":" supers)? classbody? / declaration
object <- "object" ident? (":" supers)? classbody?
function <- "fun" tparams? (receiver ".")? ident params (":" type)? constraints? (block / "=" expr)?
receiver <- "(" type ")" / ident targs? "?"? &("." ident ("." / "(" )) 
params <- "(" (param ("," param)* ","?)? ")"
param <- modifiers ident ":" type ("=" expr)?
property <- ("val" / "var") tparams? (receiver ".")? (destructured / ident (":" type)?) constraints? ("=" expr / "by" expr)? accessor*
accessor <- ";"? modifiers ("get" ("(" ")" (":" type)? (block / "=" expr))? / "set" ("(" ident (":" type)? ")" (block / "=" expr))?)
destructured <- "(" ident (":" type)? ("," ident (":" type)?)* ","? ")"
alias <- "typealias" ident tparams? "=" type
tparams <- "<" modifiers ident (":" type)? ("," modifiers ident (":" type)?)* ","? ">"
constraints <- "where" ident ":" type ("," ident ":" type)*
type <- annotation* "suspend"? (functiontype / "(" type ")" / usertype) "?"* ("&" type)?
functiontype <- ((usertype "?"? / "(" type ")" ) ".")? "(" (((ident ":")? type) ("," (ident ":")? type)* ","?)? ")" "->" type
usertype <- ident targs? ("." ident targs?)*
targs <- "<" targ ("," targ)* ","? ">"
targ <- "*" / ("in" / "out")? type
block <- "{" (stmt semi)* "}"
stmt <- annotation* ((ID "@")? (for / while / "do" (block / stmt)? "while" "(" expr ")") / local / assignment / expr)
local <- modifiers (property / function / class / object &ident)
assignment <- postfix ("=" / "+=" / "-=" / "*=" / "/=" / "%=") expr
for <- "for" "(" annotation* (destructured / ident (":" type)?) "in" expr ")" (block / stmt / ";")
while <- "while" "(" expr ")" (block / stmt / ";")
expr <- unary (("is" / "!" "is") type / ("as" / "as" "?") type / binop unary / @same ID unary)*
binop <~ "||" / "&&" / "==" / "!=" / "===" / "!==" / "<" / ">" / "<=" / ">=" / "in" / "!" "in" / "?:" / ".." / "..<" / "+" / "-" / "*" / "/" / "%"
unary <- ("-" / "+" / "++" / "--" / "!") unary / annotation unary / ID "@" @glued lambda / postfix
postfix <- primary suffix*
suffix <- ("." / "?." / "::") (ident / "class" / "(" expr ")") / "?" "::" ident / @same targs? args lambdas? / @same "[" expr ("," expr)* "]" / @same lambdas / "!!" / @same ("++" / "--")
lambdas <- (ID "@")? lambda
args <- "(" (arg ("," arg)* ","?)? ")"
arg <- annotation* (ident "=")? "*"? expr
primary <- NUM / STR / CHAR / "true" / "false" / "null" / "(" expr ")" / lambda / "object" (":" supers)? classbody / if / when / try / "throw" expr / ("return" / "return" "@" ID) (@same expr)? / ("break" / "continue") ("@" ID)? / ("this" / "super") ("<" type ">")? ("@" ID)? / "fun" params (":" type)? (block / "=" expr) / "::" ident / "[" (expr ("," expr)*)? "]" / ident
lambda <- "{" ((lparam ("," lparam)* ","?)? "->")? (stmt semi)* "}"
lparam <- destructured / ident (":" type)?
if <- "if" "(" expr ")" (block / stmt)? ";"? ("else" (block / stmt))?
when <- "when" ("(" (annotation* "val" ident (":" type)? "=")? expr ")")? "{" (whencase ("," whencase)* ","? "->" (block / stmt) ";"* / "else" "->" (block / stmt) ";"*)* "}"
whencase <- ("in" / "!" "in") expr / ("is" / "!" "is") type / expr
try <- "try" block ("catch" "(" annotation* ident ":" type ","? ")" block)* ("finally" block)?
ident <~ ID / "by" / "catch" / "constructor" / "finally" / "get" / "init" / "set" / "where" / "companion" / "enum" / "sealed" / "data" / "open" / "abstract" / "final" / "override" / "private" / "public" / "internal" / "protected" / "inline" / "suspend" / "operator" / "infix" / "lateinit" / "const" / "vararg" / "out" / "annotation" / "inner" / "tailrec" / "external" / "crossinline" / "noinline" / "reified" / "expect" / "actual" / "value" / "import"
"""

LANGUAGES: dict[str, tuple[Callable[[str], Tokens], Callable[[], str]]] = {
    "python": (lexing.lex_python, lambda: PYTHON),
    "javascript": (lexing.lex_js, lambda: _script(False)),
    "typescript": (lexing.lex_ts, lambda: _script(True)),
    "java": (lexing.lex_java, lambda: JAVA),
    "c": (lexing.lex_c, lambda: C),
    "go": (lexing.lex_go, lambda: GO),
    "rust": (lexing.lex_rust, lambda: RUST),
    "ruby": (lexing.lex_ruby, lambda: RUBY),
    "lua": (lexing.lex_lua, lambda: LUA),
    "kotlin": (lexing.lex_kotlin, lambda: KOTLIN),
}


@cache
def grammar(language: str) -> Grammar:
    return Grammar(LANGUAGES[language][1]())
