"""Dialect grammars, in the notation of ``gll``. They are permissive where only meaning could tell."""

from __future__ import annotations

import re

# ------------------------------------------------------------------ JavaScript and TypeScript

_SCRIPT = r"""
File = Item* ;
Stmts = Item* ;
Piece = Item* | Member+ ;
Item = Stmt | Import | Export ;
End = ';' | ASI ;
Block = '{' Stmts '}' ;
Stmt = Block | End | Vars End | Func | Class | Typed
     | 'if' '(' Expr ')' Stmt ('else' Stmt)?
     | 'for' 'await'? '(' ForHead ')' Stmt | 'while' '(' Expr ')' Stmt
     | 'do' Stmt 'while' '(' Expr ')' End?
     | 'return' Expr? End | 'throw' Expr End | ('break' | 'continue') ID? End | 'debugger' End
     | 'try' Block ('catch' ('(' Binding TypeNote? ')')? Block)? ('finally' Block)?
     | 'switch' '(' Expr ')' '{' Case* ASI? '}' | 'with' '(' Expr ')' Stmt
     | ID ':' Stmt | Expr End ;
Case = ('case' Expr | 'default') ':' Stmt* ;
Vars = ('const' | 'let' | 'var') Var (',' Var)* ;
Var = Binding '!'? TypeNote? ('=' Assign)? ;
ForHead = (Vars | Expr)? ';' Expr? ';' Expr?
        | ('const' | 'let' | 'var')? Binding ('of' Assign | 'in' Expr) | Suffixed ('of' Assign | 'in' Expr) ;
Import = 'import' (STR | ImportWhat 'from' STR) With? End | 'import' TypeWord ImportWhat 'from' STR End ;
ImportWhat = ID (',' (Names | '*' 'as' ID))? | Names | '*' 'as' ID ;
With = ('with' | 'assert') Object ;
Names = '{' (Alias (',' Alias)* ','?)? ASI? '}' ;
Alias = TypeWord? NAME ('as' NAME)? | STR 'as' NAME ;
Export = Decorators 'export' ('default' (Assign End | Func | Class | Typed) | Vars End | Func | Class | Typed
       | TypeWord? Names ('from' STR With?)? End | TypeWord? '*' ('as' NAME)? 'from' STR With? End) ;
Expr = Assign (',' Assign)* ;
Assign = Operand (Infix Operand)* ('?' Assign ':' Assign)? | 'yield' ('*'? Assign)? ;
Infix = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '<<='
      | '<' '<' '='? | '>' '>' '>='? | '>' '>' '>' '>='? | '>' '>=' | '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|'
      | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in'
      | '<' '<=' ;
Operand = ('!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* Suffixed ('++' | '--')? AsType*
        | Arrow | ('!' | 'await')+ Arrow ;
Arrow = 'async'? (ID | TypeParams? Params TypeNote?) '=>' (Block | Assign) ;
Suffixed = Primary (Access | Args)* | 'new' 'new'? (Primary Access* | 'new' Primary Access*) TypeArgs? Args? (Access | Args)* ;
Access = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | Args | '[' Expr ']') | '[' Expr ']' | TEMPLATE Holes END | Assured
       | TypeArgs Args ;
Args = '(' (Arg (',' Arg)* ','?)? ')' ;
Arg = '...'? Assign ;
Primary = ID | NUM | STR | TEMPLATE Holes END | REGEX | JSX Markup END | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false'
        | '(' Expr ')' | Array | Object | Func | Class | 'import' ('(' Arg (',' Arg)* ','? ')' | '.' NAME)
        | 'new' '.' NAME ;
Holes = ('${' Expr '}')* ;
Markup = ('${' ('...'? Expr)? '}')* ;
Array = '[' (','* Arg (','+ Arg)* ','* | ','*) ASI? ']' ;
Object = '{' (Prop (',' Prop)* ','?)? ASI? '}' ;
Prop = '...' Assign | Key ':' Assign | ID ('=' Assign)? | Method ;
Key = NAME | STR | NUM | PRIVATE | '[' Assign ']' ;
Method = ('async' | 'get' | 'set' | 'static' | '*')* Key Signature Block ;
Signature = TypeParams? Params TypeNote? ;
Func = 'async'? 'function' '*'? ID? Signature (Block | Bodiless) ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = Decorators Modifiers '...'? Binding Optional? TypeNote? ('=' Assign)? ;
Binding = ID | 'this' | '[' (','* Element (','+ Element)* ','* | ','*) ']' | '{' (Pick (',' Pick)* ','?)? ASI? '}' ;
Element = '...'? Binding ('=' Assign)? ;
Pick = '...' Binding | Key (':' Binding)? ('=' Assign)? ;
Decorators = ('@' Suffixed ASI?)* ;
Class = Decorators Abstract? 'class' ID? TypeParams? ('extends' Suffixed TypeArgs?)? Implements? '{' Member* '}' ;
Member = End | Decorators Modifiers (Method End? | Signed | Key Optional? Assured? TypeNote? ('=' Assign)? End | IndexType End)
       | 'static' Block ;
"""

_PLAIN = r"""
Typed = NEVER ; TypeWord = NEVER ; TypeNote = NEVER ; TypeParams = NEVER ; TypeArgs = NEVER ; AsType = NEVER ;
Assured = NEVER ; Bodiless = NEVER ; Modifiers = ('static' | 'accessor')* ; Optional = NEVER ; Abstract = NEVER ;
Implements = NEVER ; Signed = NEVER ; IndexType = NEVER ;
"""

_TYPED = r"""
Typed = Declare ('interface' ID TypeParams? ('extends' Type (',' Type)*)? TypeBody
      | 'type' ID TypeParams? '=' Type End
      | 'const'? 'enum' ID '{' (EnumItem (',' EnumItem)* ','?)? ASI? '}'
      | ('namespace' | 'module') (ID ('.' ID)* | STR) Block | 'global' Block)
      | 'declare' (Vars End | Func | Class) | 'export' '=' Expr End | 'import' ID '=' Expr End ;
Declare = 'declare'? ;
EnumItem = Key ('=' Assign)? ;
TypeWord = 'type' ;
TypeNote = ':' ('asserts'? (ID | 'this') 'is' Type | 'asserts' (ID | 'this') | Type) ;
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)? ;
TypeArgs = '<' Type (',' Type)* ','? '>' ;
Type = ('|' | '&')? OneType (('|' | '&') OneType)* ('extends' Type '?' Type ':' Type)?
     | Abstract? 'new'? TypeParams? Params '=>' ('asserts'? ID 'is' Type | Type) ;
OneType = ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer')* TypeUnit ('[' Type? ']')* ;
TypeUnit = (ID | 'void' | 'null' | 'this' | 'true' | 'false' | 'import' '(' STR ')' | 'undefined') ('.' NAME)* TypeArgs? | STR
         | '-'? NUM | TEMPLATE TypeHoles END | TypeBody | '(' Type ')' | '[' (TupleItem (',' TupleItem)* ','?)? ']' ;
TypeHoles = ('${' Type '}')* ;
TupleItem = '...'? (NAME '?'? ':')? Type '?'? ;
TypeBody = '{' ((TypeMember (';' | ',' | ASI))* TypeMember?) '}' ;
TypeMember = Modifiers (Key '?'? (Signature | TypeNote)? | 'new'? Signature | ('get' | 'set') Key Signature | IndexType
           | ('+' | '-')? 'readonly'? '[' ID 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? TypeNote?) ;
IndexType = 'static'? 'readonly'? '[' ID ':' Type ']' TypeNote ;
AsType = ('as' | 'satisfies') ('const' | Type) ;
Assured = '!' ;
Bodiless = End ;
Modifiers = ('public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor')* ;
Optional = '?' ;
Abstract = 'abstract' ;
Implements = 'implements' Type (',' Type)* ;
Signed = ('async' | 'get' | 'set' | 'static' | '*')* Key Optional? Signature End ;
"""

_SCRIPT_WORDS = (
    "of get set async static from as type interface namespace module declare abstract readonly public private "
    "protected override accessor is asserts keyof infer unique satisfies global out enum implements assert let yield "
    "await undefined"
)
JAVASCRIPT = (_SCRIPT + _PLAIN, ["File", "Piece"], _SCRIPT_WORDS, "File Stmts")
TYPESCRIPT = (_SCRIPT + _TYPED, ["File", "Piece"], _SCRIPT_WORDS, "File Stmts")

# ------------------------------------------------------------------ Java

JAVA_TEXT = r"""
File = (Notes 'package' Name ';')? Import* TypeDecl* ;
Piece = Member* ;
Members = Member* ;
Import = 'import' 'static'? ID ('.' ID)* ('.' '*')? ';' | ';' ;
TypeDecl = Modifiers (Class | Interface | Enum | Record | Annotation) | ';' ;
Modifiers = (Note | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized'
          | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')* ;
Notes = Note* ;
Note = '@' Name ('(' (NoteValue (',' NoteValue)* | ID '=' NoteValue (',' ID '=' NoteValue)*)? ')')? ;
NoteValue = Note | '{' (NoteValue (',' NoteValue)* ','?)? '}' | Expr ;
Name = ID ('.' ID)* ;
Class = 'class' ID TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? '{' Members '}' ;
Interface = 'interface' ID TypeParams? ('extends' Types)? ('permits' Types)? '{' Members '}' ;
Record = 'record' ID TypeParams? Params ('implements' Types)? '{' Members '}' ;
Annotation = '@' 'interface' ID '{' (Modifiers Type ID '(' ')' ('default' NoteValue)? ';' | Member)* '}' ;
Enum = 'enum' ID ('implements' Types)? '{' (EnumItem (',' EnumItem)* ','?)? (';' Member*)? '}' ;
EnumItem = Notes ID Args? ('{' Members '}')? ;
Types = Type (',' Type)* ;
TypeParams = '<' TypeParam (',' TypeParam)* '>' ;
TypeParam = Notes ID ('extends' Type ('&' Type)*)? ;
Type = Notes (Plain | ID TypeArgs? ('.' Notes ID TypeArgs?)*) Dims ;
Dims = (Notes '[' ']')* ;
Plain = 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean' | 'void' ;
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>' ;
TypeArg = Notes '?' (('extends' | 'super') Type)? | Type ;
Member = TypeDecl | Modifiers TypeParams? (Type ID Params Dims Throws? ('default' NoteValue)? (Block | ';') | ID Params Throws? Block | ID Block | Type Var (',' Var)* ';')
       | 'static'? Block ;
Throws = 'throws' Types ;
Params = '(' (Param (',' Param)*)? ')' ;
Param = Modifiers Type (Notes '...')? (ID | 'this') Dims ;
Var = ID Dims ('=' Init)? ;
Init = Expr | '{' (Init (',' Init)* ','?)? '}' ;
Block = '{' Stmts '}' ;
Stmts = Stmt* ;
Stmt = Block | ';' | Modifiers Type Var (',' Var)* ';' | TypeDecl | Expr ';' | ID ':' Stmt
     | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
     | 'for' '(' (ForInit? ';' Expr? ';' (Expr (',' Expr)*)? | Modifiers Type ID ':' Expr) ')' Stmt
     | 'return' Expr? ';' | 'throw' Expr ';' | ('break' | 'continue') ID? ';' | 'yield' Expr ';'
     | 'assert' Expr (':' Expr)? ';' | 'synchronized' '(' Expr ')' Block
     | 'try' ('(' Resource (';' Resource)* ';'? ')')? Block ('catch' '(' Modifiers Type ('|' Type)* ID ')' Block)* ('finally' Block)?
     | 'switch' '(' Expr ')' Switch ;
Switch = '{' ((Label ':')+ Stmt* | Label '->' (Expr ';' | Block | 'throw' Expr ';'))* '}' ;
Label = 'default' | 'case' (Pattern (',' Pattern)*) ('when' Expr)? ;
Pattern = Expr | 'default' | Modifiers Type ID? ('(' (Pattern (',' Pattern)*)? ')' ID?)? ;
ForInit = Modifiers Type Var (',' Var)* | Expr (',' Expr)* ;
Resource = Modifiers Type ID '=' Expr | Expr ;
Expr = Operand (Infix Operand | 'instanceof' Pattern)* ('?' Expr ':' Expr)? ;
Infix = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '+' | '-' | '*' | '/' | '%'
      | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '>' '>' '>' | '<' '<=' ;
Operand = ('!' | '-' | '+' | '~' | '++' | '--')* Suffixed ('++' | '--')* | ('!' | '-' | '+' | '~')* '(' Type ('&' Type)* ')' Operand | Lambda ;
Lambda = (ID | '(' (LambdaParam (',' LambdaParam)*)? ')') '->' (Expr | Block) ;
LambdaParam = ID | Param ;
Suffixed = Primary ('.' TypeArgs? (ID Args? | 'this' | 'class' | 'super' Args? | 'new' Creator) | '[' Expr ']' | '::' (ID | 'new') | Args)* ;
Args = '(' (Expr (',' Expr)*)? ')' ;
Primary = ID Args? | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' Args? | 'super' Args? | '(' Expr ')' | 'new' Creator
        | Plain Dims ('.' 'class' | '::' 'new') | ID TypeArgs? ('.' ID TypeArgs?)* Dims ('.' 'class' | '::' (ID | 'new')) | 'switch' '(' Expr ')' Switch ;
Creator = TypeArgs? Notes (Plain | ID TypeArgs? ('.' ID TypeArgs?)*) (Args ('{' Members '}')? | ('[' Expr ']')+ Dims | ('[' ']')+ '{' (Init (',' Init)* ','?)? '}') ;
"""
JAVA = (JAVA_TEXT, ["File", "Piece"], "record sealed permits non yield when", "Piece Members Stmts")

# ------------------------------------------------------------------ Go

GO_TEXT = r"""
File = Package Top* ;
Package = 'package' ID ';' ;
Piece = Top* ;
Top = ';' | Import | Decl | Func ;
Import = 'import' (ImportSpec | '(' (ImportSpec? ';')* ')') ';' ;
ImportSpec = (ID | '.')? STR ;
Decl = 'var' (VarSpec | '(' (VarSpec? ';')* ')') ';' | 'const' (ConstSpec | '(' (ConstSpec? ';')* ')') ';'
     | 'type' (TypeSpec | '(' (TypeSpec? ';')* ')') ';' ;
VarSpec = Ids (Type ('=' Exprs)? | '=' Exprs) ;
ConstSpec = Ids (Type? '=' Exprs)? ;
TypeSpec = ID ('[' TypeParams ']')? '='? Type ;
TypeParams = Ids Constraint (',' Ids Constraint)* ','? ;
Constraint = '~'? Type ('|' '~'? Type)* ;
Ids = ID (',' ID)* ;
Func = 'func' Params? ID ('[' TypeParams ']')? Params Result? Block? ';'? ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = ID? '...'? Type | ID ;
Result = Type | Params ;
Block = '{' Stmts '}' ;
Stmts = Stmt* ;
Type = '*' Type | '[' ']' Type | '[' '...' ']' Type | '[' Expr ']' Type | 'map' '[' Type ']' Type | ('<-' )? 'chan' '<-'? Type
     | 'func' Params Result? | 'struct' '{' (Field? ';')* '}' | 'interface' '{' (Elem? ';')* '}' | '(' Type ')'
     | ID ('.' ID)? ('[' Type (',' Type)* ','? ']')? ;
Field = (Ids Type | '*'? ID ('.' ID)? ('[' Type (',' Type)* ']')?) STR? ;
Elem = ID Params Result? | Constraint ;
Stmt = ';' | Simple ';' | Block ';' | Decl | ID ':' ';'? Stmt? | 'return' Exprs? ';' | ('break' | 'continue') ID? ';' | 'goto' ID ';' | 'fallthrough' ';'
     | ('go' | 'defer') Expr ';' | If ';' | 'for' ForHead? Block ';'
     | 'switch' (Simple? ';')? Simple? '{' Case* '}' ';' | 'select' '{' Case* '}' ';' ;
If = 'if' (Simple? ';')? Expr Block ('else' (If | Block))? ;
ForHead = Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr ;
Case = ('case' (Simple | Types) | 'default') ':' Stmt* ;
Types = Type (',' Type)* ;
Simple = Exprs (Assignment Exprs)? | Expr ('++' | '--') | Expr '<-' Expr ;
Assignment = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
Exprs = Expr (',' Expr)* ;
Expr = Operand (Infix Operand)* ;
Infix = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
Operand = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Primary Suffix* ;
Suffix = '.' (ID | '(' ('type' | Type) ')') | '[' (TypeOrExpr (',' TypeOrExpr)* ','? | Expr? ':' Expr? (':' Expr)?) ']' | Args | Literal ;
TypeOrExpr = Type | Expr ;
Args = '(' (Arg (',' Arg)* '...'? ','?)? ')' ;
Arg = Expr | Type ;
Literal = '{' (Element (',' Element)* ','?)? ';'? '}' ;
Element = (Value ':')? Value ;
Value = Expr | Literal ;
Primary = ID | NUM | STR | CHAR | '(' (Expr | Type) ')' | 'func' Params Result? Block | '[' ']' Type | '[' '...' ']' Type | '[' Expr ']' Type
        | 'map' '[' Type ']' Type | 'struct' '{' (Field? ';')* '}' | 'chan' Type | 'interface' '{' (Elem? ';')* '}' ;
"""
GO = (GO_TEXT, ["File", "Piece"], "", "Piece Stmts")

# ------------------------------------------------------------------ Rust

RUST_TEXT = r"""
File = InnerAttr* Item* ;
Piece = Item* ;
Items = InnerAttr* Item* ;
InnerAttr = '#' '!' '[' Tokens ']' ;
Attrs = ('#' '[' Tokens ']')* ;
Tokens = Token* ;
Token = NAME | NUM | STR | CHAR | LIFETIME | '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' | '=' | ',' | ':' | '::' | '.' | '..' | '..=' | '...' | '+' | '-'
      | '*' | '/' | '%' | '!' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '=>' | '->' | '?' | ';' | '#' | '$' | '@' | '+=' | '-=' | '*='
      | '/=' | '%=' | '|=' | '&=' | '^=' | '<<=' | '~' ;
Vis = ('pub' ('(' 'in'? Path ')')?)? ;
Item = Attrs Vis (Func | Use | Struct | Enum | Union | Const | Impl | Trait | Mod | TypeAlias | Extern | MacroDef) | Attrs MacroItem | ';' ;
Func = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID Generics? '(' (SelfParam (',' Param)* ','? | Param (',' Param)* ','?)? ')' ('->' Type)? Where? (Block | ';') ;
SelfParam = Attrs ('&' LIFETIME?)? 'mut'? 'self' (':' Type)? ;
Param = Attrs (Pattern ':' Type | Type | '...') ;
Use = 'use' UseTree ';' ;
UseTree = ('::'? (ID | 'self' | 'super' | 'crate') ('::' (ID | 'self' | 'super'))*) ('as' ID | '::' ('*' | '{' (UseTree (',' UseTree)* ','?)? '}'))? | '::'? ('*' | '{' (UseTree (',' UseTree)* ','?)? '}') ;
Struct = 'struct' ID Generics? (Where? '{' (Field (',' Field)* ','?)? '}' | '(' (TupleField (',' TupleField)* ','?)? ')' Where? ';' | ';') ;
Union = 'union' ID Generics? Where? '{' (Field (',' Field)* ','?)? '}' ;
Field = Attrs Vis ID ':' Type ;
TupleField = Attrs Vis Type ;
Enum = 'enum' ID Generics? Where? '{' (Variant (',' Variant)* ','?)? '}' ;
Variant = Attrs Vis ID ('{' (Field (',' Field)* ','?)? '}' | '(' (TupleField (',' TupleField)* ','?)? ')')? ('=' Expr)? ;
Const = ('const' | 'static' 'mut'?) (ID | '_') ':' Type ('=' Expr)? ';' ;
Impl = 'unsafe'? 'impl' Generics? '!'? Type ('for' Type)? Where? '{' Items '}' ;
Trait = ('unsafe' | 'auto')* 'trait' ID Generics? (':' Bounds?)? Where? '{' Items '}' ;
Mod = 'mod' ID (';' | '{' Items '}') ;
TypeAlias = 'type' ID Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' ;
Extern = 'extern' ('crate' (ID | 'self') ('as' ID)? ';' | STR? '{' Items '}') ;
MacroDef = 'macro_rules' '!' ID ('{' Tokens '}' | ('(' Tokens ')' | '[' Tokens ']') ';') ;
MacroItem = Path '!' ID? ('{' Tokens '}' | ('(' Tokens ')' | '[' Tokens ']') ';') ;
Generics = '<' (Generic (',' Generic)* ','?)? '>' ;
Generic = Attrs (LIFETIME (':' LIFETIME ('+' LIFETIME)*)? | ID (':' Bounds?)? ('=' Type)? | 'const' ID ':' Type ('=' Expr)?) ;
Where = 'where' (WherePart (',' WherePart)* ','?)? ;
WherePart = LIFETIME ':' Bounds? | ForLife? Type ':' Bounds? ;
Bounds = Bound ('+' Bound)* '+'? ;
Bound = LIFETIME | '?'? ForLife? Path | '(' '?'? ForLife? Path ')' ;
ForLife = 'for' Generics ;
Path = '::'? Segment ('::' Segment)* ;
Segment = (ID | 'self' | 'super' | 'crate' | 'Self') ('::'? GenericArgs | '(' (Type (',' Type)* ','?)? ')' ('->' Type)?)? ;
GenericArgs = '<' (GenericArg (',' GenericArg)* ','?)? '>' ;
GenericArg = LIFETIME | Type | ID GenericArgs? ('=' Type | ':' Bounds) | '-'? NUM | STR | CHAR | Block | 'true' | 'false' ;
Type = 'mut'? Path | '<' Type ('as' Path)? '>' ('::' Segment)+ | '&' LIFETIME? 'mut'? Type | '&&' LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | '(' (Type (',' Type)* ','?)? ')'
     | '[' Type (';' Expr)? ']' | '!' | '_' | ('dyn' | 'impl') Bounds | ForLife? ('unsafe' | 'extern' STR?)* 'fn' '(' (FnParam (',' FnParam)* ','?)? ')' ('->' Type)? | Path '!' ('(' Tokens ')' | '[' Tokens ']') | Path '+' Bounds ;
FnParam = (ID ':' | '_' ':')? Type | '...' ;
Pattern = '|'? OnePattern ('|' OnePattern)* ;
OnePattern = '_' | '..' | 'ref'? 'mut'? ID ('@' Pattern)? | '-'? NUM RangeEnd? | CHAR RangeEnd? | STR | 'true' | 'false' | ('&' | '&&') 'mut'? OnePattern
           | '(' (Pattern (',' Pattern)* ','?)? ')' | '[' (Pattern (',' Pattern)* ','?)? ']' | Path ('(' (Pattern (',' Pattern)* ','?)? ')' | '{' (FieldPattern (',' FieldPattern)* ','?)? '}' | RangeEnd | '!' '(' Tokens ')')?
           | ('..=' | '..') ('-'? NUM | CHAR | Path) | 'box' OnePattern ;
RangeEnd = ('..=' | '..' | '...') ('-'? NUM | CHAR | Path)? ;
FieldPattern = Attrs ('..' | 'ref'? 'mut'? ID (':' Pattern)? | NUM ':' Pattern) ;
Block = '{' Stmts '}' ;
Stmts = InnerAttr* (Stmt* Expr?) ;
Stmt = ';' | Item | Attrs 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';' | Attrs Expr ';' | Attrs Blocky ;
Blocky = (LIFETIME ':')? ('unsafe' | 'async' 'move'? | 'const')? Block | If | Match | (LIFETIME ':')? ('loop' Block | 'while' Cond Block | 'for' Pattern 'in' Expr Block) | Path '!' '{' Tokens '}' ;
If = 'if' Cond Block ('else' (If | Block))? ;
Cond = Expr | 'let' Pattern '=' Expr ('&&' Cond)? | Expr '&&' 'let' Pattern '=' Expr ('&&' Cond)? ;
Match = 'match' Expr '{' InnerAttr* Arm* '}' ;
Arm = Attrs Pattern ('if' Cond)? '=>' (Expr ',' | Expr | Blocky ','?) ;
Expr = Operand (Infix Operand | 'as' Type)* (('..' | '..=') (Operand (Infix Operand)*)?)? | ('..' | '..=') (Operand (Infix Operand)*)? | Closure
     | 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME? | 'yield' Expr? ;
Infix = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>'
      | '<=' | '>=' | '<' '<' | '>' '>' ;
Closure = ForLife? ('static' | 'async' | 'move')* ('||' | '|' (ClosureParam (',' ClosureParam)* ','?)? '|') ('->' Type Block | Expr) ;
ClosureParam = Attrs OnePattern (':' Type)? ;
Operand = ('-' | '!' | '*' | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))?)* (Primary Suffix* | Closure | 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME?) ;
Suffix = '.' (ID ('::' GenericArgs)? | NUM | 'await') | '(' (Expr (',' Expr)* ','?)? ')' | '[' Expr ']' | '?' ;
Primary = Path | '<' Type ('as' Path)? '>' ('::' Segment)+ | NUM | STR | CHAR | 'true' | 'false' | '(' (Expr (',' Expr)* ','?)? ')'
        | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | Path '{' (FieldInit (',' FieldInit)* ','?)? ('..' Expr?)? '}' | Blocky
        | Path '!' ('(' Tokens ')' | '[' Tokens ']') | '_' ;
FieldInit = Attrs (ID | NUM) (':' Expr)? | '..' Expr ;
"""
RUST = (RUST_TEXT, ["File", "Piece"], "union auto macro_rules raw box yield", "Piece")

# ------------------------------------------------------------------ C and C++

C_TEXT = r"""
File = Top* ;
Piece = Top* ;
Top = ';' | Decl | Function | 'extern' STR '{' Top* '}' | ID Args ';'? | 'asm' Args ';' | '_Static_assert' Args ';' ;
Qual = 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'register' | 'restrict' | 'auto' | 'typedef' | '_Noreturn' | '_Thread_local' | '__inline' | '__extension__' | '__restrict' | Attribute | '_Atomic' | 'constexpr' | 'thread_local' ;
Attribute = '__attribute__' Args | '[' '[' Anything ']' ']' | '__declspec' Args | '_Alignas' Args ;
Anything = (NAME | NUM | STR | CHAR | ',' | '::' | ':' | '(' Anything ')')* ;
Basic = 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Complex' ;
Specs = Qual* (Basic (Basic | Qual)* | (Record | EnumSpec | ID | 'typeof' Args) Qual*) ;
Record = ('struct' | 'union') Attribute* (ID ('{' Fields '}')? | '{' Fields '}') Attribute* ;
Fields = (Specs ((Declarator (':' Expr)? | ':' Expr) (',' (Declarator (':' Expr)? | ':' Expr))*)? Attribute* ';' | ';' | '_Static_assert' Args ';')* ;
EnumSpec = 'enum' Attribute* (ID ('{' EnumItems '}')? | '{' EnumItems '}') ;
EnumItems = EnumItem (',' EnumItem)* ','? ;
EnumItem = ID Attribute* ('=' Assign)? ;
Declarator = ('*' Qual*)* (ID | '(' Declarator ')') ('[' Qual* (Assign | '*')? ']' | '(' ParamList ')')* ;
Abstract = ('*' Qual*)* ('(' Abstract ')')? ('[' Assign? ']' | '(' ParamList ')')* ;
ParamList = (Param (',' Param)* (',' '...')? | '...')? ;
Param = Specs (Declarator | Abstract) ;
InitDecl = Declarator Attribute* ('asm' Args)? ('=' Init)? ;
Decl = Specs (InitDecl (',' InitDecl)*)? ';' ;
Called = ('*' Qual*)* (ID | '(' Declarator ')') '(' ParamList ')' ('[' Assign? ']' | '(' ParamList ')')* ;
Function = Specs Called Attribute* (Decl)* Block | Qual* Called Block ;
Init = Assign | Braced ;
Braced = '{' (InitItem (',' InitItem)* ','?)? '}' ;
InitItem = (('.' ID | '[' Expr ('...' Expr)? ']')+ '=' | ID ':')? Init ;
Block = '{' Stmts '}' ;
Stmts = Stmt* ;
Stmt = Block | ';' | Decl | Expr ';' | ID ':' Attribute* Stmt? | 'case' Expr ('...' Expr)? ':' Stmt? | 'default' ':' Stmt?
     | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'switch' '(' Expr ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
     | 'for' '(' (Decl | Expr? ';') Expr? ';' Expr? ')' Stmt | 'goto' ('*' Expr | ID) ';' | 'break' ';' | 'continue' ';' | 'return' Expr? ';' | 'asm' 'volatile'? Args ';' ;
Expr = Assign (',' Assign)* ;
Assign = Operand (Infix Operand)* ('?' Expr? ':' Assign)? (Setter Assign)? ;
Setter = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
Infix = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | Setter ;
Operand = Prefix* (Primary Suffix* | Cast Operand) ;
Cast = '(' Specs Abstract ')' ;
Prefix = '*' | '&' | '!' | '~' | '-' | '+' | '++' | '--' | 'sizeof' | '_Alignof' | '__extension__' | '&&' ;
Suffix = '.' ID | '->' ID | '[' Expr ']' | Args | '++' | '--' ;
Args = '(' (Arg (',' Arg)*)? ')' ;
Arg = Assign | Specs Abstract ;
Primary = ID | NUM | STR STR* | CHAR | '(' Expr ')' | '(' Block ')' | Cast Braced | 'sizeof' '(' Specs Abstract ')' | '_Alignof' '(' Specs Abstract ')' | 'true' | 'false' | 'nullptr'
        | '_Generic' '(' Assign (',' (Specs Abstract | 'default') ':' Assign)+ ')' | ID STR | STR ID STR* ;
"""
C = (C_TEXT, ["File", "Piece"], "auto constexpr bool asm typeof true false nullptr thread_local", "File Piece Stmts")

CPP_TEXT = r"""
File = Top* ;
Piece = Member* ;
Tops = Top* ;
Top = ';' | Decl | Function | Template | 'extern' STR ('{' Tops '}' | Top) | 'inline'? 'namespace' Attribute* (ID ('::' 'inline'? ID)*)? Attribute* '{' Tops '}' | 'namespace' ID '=' Name ';'
    | Using | 'static_assert' Args ';' | ID Args ';'? | 'asm' Args ';' | 'export'? ('module' | 'import') (ID ('.' ID)*)? ';' | Concept ;
Using = 'using' ('namespace' Name | 'enum'? 'typename'? Name (',' Name)* | ID Attribute* '=' TypeId) ';' ;
Concept = 'concept' ID '=' Expr ';' ;
Template = 'template' (TemplateParams Requires?)? (Decl | Function | Template | Using | Concept | 'friend' Decl) | 'extern' 'template' Decl ;
TemplateParams = '<' (TemplateParam (',' TemplateParam)*)? '>' ;
TemplateParam = ('class' | 'typename') '...'? ID? ('=' TypeId)? | TemplateParamsOf | Param | Name '...'? ID ('=' TypeId)? ;
TemplateParamsOf = 'template' TemplateParams ('class' | 'typename') '...'? ID? ('=' Name)? ;
Requires = 'requires' Operand (('&&' | '||') Operand)* ;
Qual = 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'register' | 'mutable' | 'constexpr' | 'consteval' | 'constinit' | 'virtual' | 'explicit' ('(' Expr ')')? | 'friend' | 'typedef' | 'thread_local' | Attribute ;
Attribute = '__attribute__' Args | '[' '[' Anything ']' ']' | 'alignas' Args | '__declspec' Args ;
Anything = (NAME | NUM | STR | CHAR | ',' | '::' | ':' | '(' Anything ')')* ;
Basic = 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | 'bool' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t' ;
Name = '::'? Part ('::' 'template'? Part)* ;
Part = ID TemplateArgs? | '~' ID | 'operator' Op | 'decltype' Args ;
Op = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<' '<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!='
   | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | ('new' | 'delete') ('[' ']')? | TypeId | STR ID? ;
TemplateArgs = '<' (TemplateArg (',' TemplateArg)*)? '>' ;
TemplateArg = (TypeId | NoAngle) '...'? ;
NoAngle = Operand (SafeInfix Operand)* ;
SafeInfix = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<=' ;
Specs = Qual* (Basic (Basic | Qual)* | (Record | EnumSpec | 'typename'? Name | 'auto' | 'decltype' Args | 'typeof' Args) Qual*) ;
Record = ('class' | 'struct' | 'union') Attribute* (Name 'final'? Bases? ('{' Members '}')? | Bases? '{' Members '}') ;
Bases = ':' Base (',' Base)* ;
Base = ('public' | 'private' | 'protected' | 'virtual')* Name '...'? ;
Members = Member* ;
Member = ';' | ('public' | 'private' | 'protected' | 'signals' | 'slots') (ID)? ':' | Specs (MemberDecl (',' MemberDecl)*)? ';' | Function | Template | Using | 'static_assert' Args ';' | 'friend' Decl | ID Args ';'? ;
MemberDecl = InitDecl | Declarator? ':' Expr ('=' Init)? | Declarator Tail ('=' ('0' | NUM | 'default' | 'delete'))? ;
EnumSpec = 'enum' ('class' | 'struct')? Attribute* Name? (':' Specs)? ('{' (EnumItem (',' EnumItem)* ','?)? '}')? ;
EnumItem = ID Attribute* ('=' Assign)? ;
Pointer = '*' Qual* | '&' Qual* | '&&' Qual* | Name '::' '*' Qual* ;
Declarator = Pointer* ('...'? Name | '(' Declarator ')' | '[' ID (',' ID)* ']') ('[' Expr? ']' | '(' ParamList ')' Tail | Attribute)* ;
Tail = ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' Expr ')')? | 'throw' Args | 'override' | 'final' | '->' TypeId | Requires | Attribute)* ;
Abstract = Pointer* '...'? ('(' Abstract ')')? ('[' Expr? ']' | '(' ParamList ')' Tail)* ;
TypeId = Specs Abstract ;
ParamList = (Param (',' Param)* (','? '...')? | '...')? ;
Param = ('this')? Specs (Declarator | Abstract) ('=' Init)? ;
InitDecl = Declarator ('=' Init | Braced | Args)? ;
Decl = Specs (InitDecl (',' InitDecl)*)? ';' ;
Called = Pointer* (Name | '(' Declarator ')') Attribute* '(' ParamList ')' Tail ('(' ParamList ')' Tail)* ;
Function = (Specs? | Qual*) Called (Ctor? Block | '=' ('default' | 'delete' | NUM) ';' | Ctor? 'try' Block Catch+ | ';') ;
Ctor = ':' (Name (Args | Braced) '...'?) (',' Name (Args | Braced) '...'?)* ;
Init = Assign | Braced ;
Braced = '{' (InitItem (',' InitItem)* ','?)? '}' ;
InitItem = (('.' ID | '[' Expr ']')+ '='?)? Init '...'? ;
Block = '{' Stmts '}' ;
Stmts = Stmt* ;
Catch = 'catch' '(' ('...' | Param) ')' Block ;
Stmt = Attribute* (Block | ';' | Decl | Expr ';' | ID ':' Stmt? | 'case' Expr ('...' Expr)? ':' Stmt? | 'default' ':' Stmt?
     | 'if' 'constexpr'? '(' ((Decl | Expr? ';' | Using)? (Specs InitDecl | Expr)) ')' Stmt ('else' Stmt)? | 'switch' '(' (Decl | Expr ';')? (Expr | Specs InitDecl) ')' Stmt
     | 'while' '(' (Expr | Specs InitDecl) ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
     | 'for' '(' ((Decl | Expr? ';') Expr? ';' Expr? | (Decl)? Specs Declarator ':' Init) ')' Stmt | 'goto' ID ';' | 'break' ';' | 'continue' ';'
     | ('return' | 'co_return') Init? ';' | 'try' Block Catch+ | Using | 'namespace' ID '=' Name ';' | 'static_assert' Args ';' | 'asm' 'volatile'? Args ';') ;
Expr = Assign (',' Assign)* ;
Assign = Operand (Infix Operand)* ('?' Expr ':' Assign)? (Setter Init)? | 'throw' Assign? | 'co_yield' Init ;
Setter = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
Infix = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '<' '<' | '>' '>' | '.*' | '->*' | Setter ;
Operand = Prefix* (Primary Suffix* | '(' TypeId ')' (Operand | Braced) | New) ;
Prefix = '*' | '&' | '&&' | '!' | '~' | '-' | '+' | '++' | '--' | 'sizeof' '...'? | 'delete' ('[' ']')? | '::' 'delete' | 'co_await' | 'noexcept' | 'alignof' ;
New = '::'? 'new' Args? (Specs Pointer* ('[' Expr ']')* | '(' TypeId ')') (Args | Braced)? Suffix* ;
Suffix = '.' 'template'? Name | '->' 'template'? Name | '[' (Expr | Braced)? ']' | Args | Braced | '++' | '--' ;
Args = '(' (Arg (',' Arg)*)? ')' ;
Arg = (Init | TypeId) '...'? ;
Primary = Name | NUM | STR STR* | CHAR | 'this' | 'true' | 'false' | 'nullptr' | '(' Expr ')' | '(' Block ')' | '(' Fold ')' | Lambda | (Basic+ | 'auto' | 'typename' Name) (Args | Braced) | 'sizeof' '(' TypeId ')' | 'typeid' Args
        | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' TypeId '>' Args | 'requires' ('(' ParamList ')')? Block | STR ID | ID STR ;
Fold = (Operand Infix)? '...' Infix Operand | Operand Infix '...' (Infix Operand)? ;
Lambda = '[' (Capture (',' Capture)*)? ']' TemplateParams? ('(' ParamList ')')? ('mutable' | 'constexpr' | 'static' | 'noexcept' ('(' Expr ')')? | Attribute)* ('->' TypeId)? Block ;
Capture = '&' | '=' | '*'? 'this' | '&'? '...'? ID '...'? ('=' Init | Braced | Args)? ;
"""
CPP = (
    CPP_TEXT,
    ["File", "Piece"],
    "final override module import signals slots asm typeof concept requires",
    "File Piece Tops Stmts Members",
)

# ------------------------------------------------------------------ Python 3

PYTHON_TEXT = r"""
File = Line* ;
Lines = Line* ;
Line = Simple (';' Simple)* ';'? NL | Compound ;
Suite = NL INDENT Lines DEDENT | Simple (';' Simple)* ';'? NL ;
Simple = 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Expr ('from' Expr)?)? | 'global' ID (',' ID)* | 'nonlocal' ID (',' ID)*
       | 'del' Targets | 'assert' Expr (',' Expr)? | 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)*
       | 'from' ('.' | '...')* Dotted? 'import' ('*' | Imports | '(' Imports ','? ')') | 'type' ID TypeParams? '=' Expr
       | Stars (('=' (Stars | Yield))+ | Augment (Stars | Yield) | ':' Expr ('=' (Stars | Yield))?)? | Yield ;
Imports = ID ('as' ID)? (',' ID ('as' ID)?)* ;
Dotted = ID ('.' ID)* ;
Augment = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Yield = 'yield' ('from' Expr | Stars)? ;
Targets = Postfix (',' Postfix)* ','? ;
Compound = Decorators ('async'? 'def' ID TypeParams? '(' Params ')' ('->' Expr)? ':' Suite | 'class' ID TypeParams? ('(' Args ')')? ':' Suite)
         | 'if' Named ':' Suite ('elif' Named ':' Suite)* ('else' ':' Suite)?
         | 'while' Named ':' Suite ('else' ':' Suite)? | 'async'? 'for' Stars 'in' Stars ':' Suite ('else' ':' Suite)?
         | 'try' ':' Suite ((('except' '*'? (Expr (',' Expr)* ('as' ID)?)? ':' Suite)+ ('else' ':' Suite)?)? 'finally' ':' Suite | ('except' '*'? (Expr (',' Expr)* ('as' ID)?)? ':' Suite)+ ('else' ':' Suite)?)
         | 'async'? 'with' (WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')') ':' Suite
         | 'match' Stars ':' NL INDENT ('case' Patterns ('if' Named)? ':' Suite)+ DEDENT ;
WithItem = Expr ('as' Postfix)? ;
Decorators = ('@' Named NL)* ;
TypeParams = '[' (('*' | '**')? ID (':' Expr)? ('=' Expr)?) (',' ('*' | '**')? ID (':' Expr)? ('=' Expr)?)* ','? ']' ;
Params = (Param (',' Param)* ','?)? ;
Param = ID (':' Expr)? ('=' Expr)? | '/' | '*' (ID (':' ('*'? Expr))?)? | '**' ID (':' Expr)? ;
Patterns = OpenPattern (',' OpenPattern)* ','? ;
OpenPattern = '*' ID | Pattern ;
Pattern = OnePattern ('|' OnePattern)* ('as' ID)? ;
OnePattern = '-'? NUM (('+' | '-') NUM)? | (STR | FSTR Fields END)+ | 'None' | 'True' | 'False' | Dotted ('(' (PatternArg (',' PatternArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']'
           | '{' ((('-'? NUM | STR+ | Dotted | 'None' | 'True' | 'False') ':' Pattern | '**' ID) (',' (('-'? NUM | STR+ | Dotted | 'None' | 'True' | 'False') ':' Pattern | '**' ID))* ','?)? '}' ;
PatternArg = (ID '=')? Pattern ;
Stars = Star (',' Star)* ','? ;
Star = '*' Expr | Named ;
Named = ID ':=' Expr | Expr ;
Expr = Or ('if' Or 'else' Expr)? | Lambda ;
Lambda = 'lambda' (LambdaParam (',' LambdaParam)* ','?)? ':' Expr ;
LambdaParam = ID ('=' Expr)? | '/' | '*' ID? | '**' ID ;
Or = 'not'* Operand (Infix 'not'* Operand)* ;
Infix = 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? | '<' | '>' | '==' | '>=' | '<=' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
Operand = ('-' | '+' | '~')* 'await'? Postfix ;
Postfix = Atom ('.' ID | '(' Args ')' | '[' Slices ']')* ;
Args = (Arg (',' Arg)* ','?)? ;
Arg = ID '=' Expr | '*' Expr | '**' Expr | Named | Named Comp ;
Slices = Slice (',' Slice)* ','? ;
Slice = '*' Expr | Named | Expr? ':' Expr? (':' Expr?)? ;
Comp = ('async'? 'for' CompTargets 'in' Or ('if' 'not'* Condition)*)+ ;
CompTargets = ('*'? Postfix) (',' '*'? Postfix)* ','? ;
Condition = ID ':=' Or | Or | Lambda ;
Fields = ('${' (Yield | Stars) '}')* ;
Atom = ID | NUM | (STR | FSTR Fields END)+ | 'None' | 'True' | 'False' | '...' | '(' (Yield | Stars | Named Comp)? ')' | '[' (Stars | Star Comp)? ']'
     | '{' (Dict | Stars | Star Comp)? '}' ;
Dict = DictItem (',' DictItem)* ','? | Expr ':' Expr Comp ;
DictItem = Expr ':' Expr | '**' Expr ;
"""
PYTHON = (PYTHON_TEXT, ["File"], "match case type", "File Lines")

# ------------------------------------------------------------------ JSON and YAML

JSON_TEXT = r"""
File = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | '[' (Value (',' Value)*)? ']' | '{' (STR ':' Value (',' STR ':' Value)*)? '}' ;
"""
JSON = (JSON_TEXT, ["File"], "", "")

#: over the lexer's lines: a line is its head tokens, NL and the block of deeper lines
YAML_TEXT = r"""
File = Document (SEPARATOR Document)* ;
Document = Node? ;
Node = Entry+ | Item+ | Scalar NL (INDENT Rest DEDENT)? | Flow NL ;
Rest = (Scalar NL)* ;
Entry = KEY Props Value? NL Deeper? | QUESTION Scalar? NL Deeper? | MERGE Value? NL Deeper? ;
Deeper = INDENT Node DEDENT ;
Item = DASH NL? (INDENT Node DEDENT)? ;
Props = PROP* ;
Value = Scalar | Flow | BLOCKTEXT | ALIAS ;
Scalar = Props (PLAIN | STR) ;
Flow = Props ('[' (FlowItem (',' FlowItem)* ','?)? ']' | '{' (FlowItem (',' FlowItem)* ','?)? '}') ;
FlowItem = (FlowNode FLOWKEY)? FlowNode? | FlowNode ;
FlowNode = Props (PLAIN | STR | ALIAS | '[' (FlowItem (',' FlowItem)* ','?)? ']' | '{' (FlowItem (',' FlowItem)* ','?)? '}') ;
"""
YAML = (YAML_TEXT, ["File"], "", "")


def together(*dialects: tuple[str, tuple]) -> tuple:
    """One grammar whose File and Piece derive what any dialect's do: all are read at once on one graph-structured
    stack. Each dialect has a prefix for its rules; what is a word of the others only is an identifier to it."""
    word = re.compile(r"'[^']*'|[A-Za-z_]\w*")
    quoted = {p: {w[1:-1] for w in re.findall(r"'[A-Za-z_]\w*'", g[0])} for p, g in dialects}
    texts, lists = [], []
    for prefix, (text, _, contextual, own_lists) in dialects:
        rules = set(re.findall(r"^(\w+) =", text, re.M))
        free = {w for p, own in quoted.items() if p != prefix for w in own} - quoted[prefix] | set(contextual.split())
        name = "(ID | " + " | ".join(f"'{w}'" for w in sorted(free)) + ")"
        named = lambda m: f"{prefix}{m[0]}" if m[0] in rules else name if m[0] == "ID" else m[0]  # noqa: B023, E731
        texts.append(word.sub(named, text))
        lists += [prefix + x for x in own_lists.split()]
    starts = ["File", "Piece"]
    joint = "".join(f"{x} = {' | '.join(p + x for p, _ in dialects)} ;\n" for x in starts)
    return joint + "".join(texts), starts, "", " ".join(lists)


#: C as the lexer of C++ cuts it, in which >> is two tokens
HEADER = together(("C", (C_TEXT.replace("'>>'", "'>' '>'"), *C[1:])), ("Cpp", CPP))
