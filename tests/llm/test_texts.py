"""Secrets, parsing, hand-written code, encoding, leaks and shared spans on small texts."""

from __future__ import annotations

import ast
import random
import re
import time

import pytest

from skillweave.llm import encoding, handwritten, leaks, parsing, secrets, spans
from skillweave.llm.automaton import Automaton

# made up at run time, so that no literal credential stands in the repository
BODY = "Qz7" + "x9Kd2Lm5Np8Rt4Vw6Yb3Cf1Gh0Js"
TOKEN = "gh" + "p_" + BODY + "aBcD12"
PASSWORD = "Correct" + "Horse42!"


def test_automaton_like_regular_expressions():
    draw = random.Random(1)
    patterns = ["ab+c", "x[0-9]{2,3}y", "(foo|ba?r)z", "[^a-z]q"]
    data = "".join(draw.choices("abcxyfozrq019Q -", k=6000))
    want = {m.end() - 1 for p in patterns for i in range(len(data)) if (m := re.compile(p, re.I).match(data, i))}
    # the leftmost match of each start is one of the ends; the automaton finds all ends
    got = set(Automaton(patterns).ends(data.encode(), chunk=64, overlap=32).tolist())
    assert want <= got
    for end in got:
        assert any(re.compile(f"(?:{p})\\Z", re.I).search(data[max(0, end - 40) : end + 1]) for p in patterns)
    assert len(Automaton(["a"]).ends(b"")) == 0


def found(text: str) -> list[tuple[int, str]]:
    hits = dict(secrets.batch_lines([text]))
    return [(text.count("\n", 0, s.begin) + 1, s.kind) for s in secrets.find_secrets(text, hits.get(0, []))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"token = '{TOKEN}'", [1]), (f"x = 1\n# was {TOKEN}\n", [2]), (f'a = "{TOKEN[:9]}" + "{TOKEN[9:]}"', [1]),
        (f'api_token = (\n    "{TOKEN[:12]}"\n    "{TOKEN[12:]}"\n)', [2]), (f'password = "{PASSWORD}"', [1]),
        (f'password = os.environ.get("PASSWORD", "{PASSWORD}")', [1]), (f'const pwd = process.env.PWD || "{PASSWORD}";', [1]),
        (f"db:\n  password: {PASSWORD}\n  port: 1\n", [2]), (f"# staging password: {PASSWORD}", [1]), (f'{{"password_2": "{PASSWORD}"}}', [1]),
        (f"url = 'mysql://app:{BODY}@db.example.invalid/x'", [1]), ("url = 'https://${USER}:${PASS}@db.invalid/x'", []), ("url = 'https://db.invalid/x'", []),
        ('password = os.environ["PASSWORD"]', []), ('const char *password = getenv("PASSWORD");', []), ('password_hint = "ask Bob99 now"', []),
        ("password = 12345", []), ('password = "********"', []), ('api_key = "<your-api-key>"', []), ('token = "YOUR_TOKEN_HERE"', []),
        ('secret = "{{ vault_token }}"', []), (f'checksum = "{"0123456789abcdef" * 4}"', []), (f'hmac_secret = "{"0f1e2d3c4b5a6978" * 2}"', [1]),
        ("auth = 'Bearer '", []), (f"auth = 'Bearer {BODY}'", [1]), ("k = '" + "gh" + "p_" + "x" * 36 + "'", []), ("", []), ("é\n" * 50, []),
        ("k = '''" + "-----BEGIN RSA " + "PRIVATE KEY-----\n" + BODY * 3 + "\n-----END RSA " + "PRIVATE KEY-----'''", [1]),
        ("if text.startswith('" + "-----BEGIN " + "PRIVATE KEY-----'): pass", []),
        ("k = '-----BEGIN PUBLIC KEY-----\\n" + BODY * 3 + "\\n-----END PUBLIC KEY-----'", []), ("def f(password: str, token=None): return password", []),
    ],
)
def test_secrets(text, want):
    assert [n for n, _ in found(text)] == want


def test_redaction_keeps_the_code(spark):
    text = f'a = 1\nk = (\n    "{TOKEN[:12]}"\n    "{TOKEN[12:]}"\n)\npassword = "{PASSWORD}"  # é\n'
    key = "k = '''" + "-----BEGIN EC " + "PRIVATE KEY-----\n" + BODY * 3 + "\n-----END EC " + "PRIVATE KEY-----'''\n"
    rows = [("a", text, 1), ("b", None, 1), ("c", "", 1), ("d", "x = 1", 1), ("e", key + text, 1), ("e", key + text, 2)]
    df = spark.createDataFrame(rows, "data_id string, code string, line int")
    out = {r.id: r for r in secrets.redacted(df, "data_id", "code").collect()}
    assert (out["b"].text, out["c"].text, out["d"].text) == (None, "", "x = 1")
    for k, t in (("a", text), ("e", key + text)):
        new = out[k].text
        assert new.count("\n") == t.count("\n") and found(new) == [] and TOKEN[12:] not in new and PASSWORD not in new
        assert [type(x) for x in ast.walk(ast.parse(new))] == [type(x) for x in ast.walk(ast.parse(t))]
    lines = {(r.id, r.line) for r in secrets.embedded_secrets(df, "data_id", "code").collect()}
    assert lines == {("a", 3), ("a", 6), ("e", 1), ("e", 6), ("e", 9)}
    assert secrets.embedded_secrets(df.where("false"), "data_id", "code").count() == 0


def test_long_values_are_redacted_to_their_end():
    draw = random.Random(2)
    body = ["".join(draw.choices("ABCDEFGHJKLMNPQRSTabcdefghjkmnpqrst23456789", k=64)) for _ in range(300)]
    for most in (1, 25, 300):
        block = ["-----BEGIN RSA " + "PRIVATE KEY-----", *body[:most], "-----END RSA " + "PRIVATE KEY-----"]
        texts = {
            "glued": "k = (\n" + "".join(f'    "{x}\\n"\n' for x in block) + ")\nx = 'kept'\n",
            "noted": "k = (\n" + "".join(f'    "{x}"  # a\n' for x in block) + ")\nx = 'kept'\n",
            "listed": "k = [\n" + "".join(f'    "{x}",\n' for x in block) + "]\nx = 'kept'\n",
            "mixed": f'k = "{block[0]}\\n{body[0]}"\nk = f(k, [\n' + "".join(f'    "{x}",\n' for x in block[1:]) + "])\nx = 'kept'\n",
            "whole": "k = '''" + "\n".join(block) + "'''\nx = 'kept'\n",
            "raw": "\n".join(block) + "\nkept\n",
            "no end": "\n".join(block[:-1]) + "\n\ndef kept(): pass\n",
        }
        for name, text in texts.items():
            new = secrets.redact(text, secrets.find_secrets(text, dict(secrets.batch_lines([text]))[0]))
            assert not any(x in new for x in block[1:]) and "kept" in new and new.count("\n") == text.count("\n"), (name, most)
            if name in ("glued", "noted", "whole"):
                assert len(ast.parse(new).body) == len(ast.parse(text).body)


def test_long_chains_take_linear_time():
    text = "k = (\n" + f'    "token of {BODY[:9]}"\n' * 20_000 + ")\n"
    began = time.process_time()
    assert found(text) == [] and time.process_time() - began < 30


def test_all_names_of_the_grammar_have_anchors():
    words = sorted(secrets._PASS_WORDS | secrets._SECRET_WORDS) + [f"{a}{p}key" for a in sorted(secrets._KEY_OWNERS) for p in ("_", "-", "__", "é_", "_" * 300)]
    words += [a + "Key" for a in sorted(secrets._KEY_OWNERS)]
    texts = []
    for word in words:
        for name in (word, word.upper() if "Key" not in word else word, "my_" + word, word + "_2", word + "3", word + "_", word + "é", "a.b." + word):
            assert secrets.name_kind(name), name
            texts += [f"{name} = 1", f'"{name}": 1', f"x[{name}] = 1", f"{name}:=1", "-" * 900 + f" {name}: str = 1"]
    assert dict(secrets.batch_lines(texts)) == {i: [0] for i in range(len(texts))}
    for name in ("deploy_key", "serviceKey", "shared_key", "ssh-key", "tlsKey", "cryptoKey", "encrypt_key", "sign_key", "passcode"):
        text = f'x = 1\n{name}: "{BODY}"\n'
        assert [n for n, _ in found(text)] == [2]
        assert BODY not in secrets.redact(text, secrets.find_secrets(text, dict(secrets.batch_lines([text]))[0]))
    assert [n for n, _ in found(f"auth = 'Bearer\t{BODY}'")] == [1]


VALID = {
    "py": ["", "x = 1\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c}: pass\n    case A(x=1) | None as y: pass\n", "def f(a, /, b: int = 1, *c, d, **e) -> int:\n  '''x'''\n  return [i async for i in f() if i if j]\n", "with (open(a) as b, c): pass\n",
           "x = f'{a!r:>{w}}' 'b' rb'c'\nprint(*a, sep='')\nlambda *a, b=1: (yield)\n", "class A[T](B, m=C):\n\tx: int\n\t@p\n\tdef f(self): ...\ntype X = int\n", "try:\n    a\nexcept* (A, B) as e:\n    b\nelse:\n    c\nfinally:\n    d\n",
           "if (y := f(x)) > 1: z = a[1:2, ::3, ...]\nelif 0x1F_0 is not 1_0.5e-3j: del a.b, c[0]\nelse: pass\n", "x = \\\n    1\n\nfor a, *b in c: continue\nelse: pass\n", "match = 1; case = match; type = case\n", "async def f():\n    async with a as b: await c\n    return not a in b\n"],
    "js": ["", "import a, { b as c } from 'd'\nexport default async () => { await a }\n", "const re = /[/\\]]+/g.test(x) ? a / b / c : `t${`n${1}`}`\nlet [a, , ...b] = c, { d: { e = 1 }, ...f } = g\n", "class A extends (b, c) { static #p = 1; get x() { return this.#p } async *[y]() {} static { z() } }",
           "for (const x of y) label: for (;;) { break label }\nif (a) b; else do c; while (d)\nswitch (x) { case 1: default: y() }\n", "a ?.b?.[c]?.(d) ?? e\nx = { a, b() {}, get c() { return 1 }, [d]: e, ...f }\nvar f = function* () { yield* x }\n", "const v = <A b={c} {...d}>t {x} <b/></A>;\n", "x\n++y\nreturn\n"],
    "ts": ["type A<T extends B = C> = T extends (infer U)[] ? U : keyof T & { readonly [K in keyof T]?: T[K] };\n", "export abstract class A<T> implements B { private readonly x: Map<string, A<T>[]> = new Map(); constructor(public a?: string) { super() } abstract f(): void; }\n",
           "function f<T>(this: A, x: T | null = null, ...r: number[]): x is T { return (x as unknown as B)!.c! }\ndeclare module 'x' { export const a: 1 }\nenum E { A = 1 << 2, B }\n", "let f = <T,>(a: T): T => a; let g: (a: number) => void; f<string>('x'); a < b; const x = y satisfies Z;\n"],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype S[T any] struct {\n\ta, b int `json:\"x\"`\n\t*E\n}\n\ntype I interface {\n\tF(int) (string, error)\n\t~int | string\n}\n", "package a\n\nfunc (s *S[T]) F(xs ...int) (n int, err error) {\n\tfor i := range xs {\n\t\tif v, ok := m[i]; ok && v != nil {\n\t\t\tcontinue\n\t\t} else if !ok {\n\t\t\tgo func() { c <- <-d }()\n\t\t}\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}, &S{\n\t\ta: 1,\n\t}\n}\n"],
    "java": ["package a;\nimport static b.C.*;\n@X(y = {1, 2})\npublic final class A<T extends B & C> extends D<T[]> implements E {\n  private static final int[] X = {1, 2};\n  A() { this(1); }\n  <U> U f(final U... u) throws G { for (var x : y) try (var r = z()) { } catch (H | I e) { throw e; } finally { }\n return (T) -> x::new; }\n}\n".replace("(T) -> x::new", "a -> B::new"),
             "enum E { A(1) { void f() {} }, B; int x; }\nrecord R(int a) {}\ninterface I { default int f() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\n", "class A { void f() { List<Map<String, int[]>> x = new ArrayList<>() {}; int y = (int) z >>> 2; a[0]++; label: while (true) break label; if (o instanceof B b && b.c()) return; String t = \"\"\"\n x\n \"\"\"; } }\n"],
    "rs": ["use a::{b, c::*, self as d};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a = C> where T: D { pub(crate) x: &'a mut T, }\nimpl<T> Tr for A<'_, T> { type X = u8; const Y: u8 = 1; fn f(&mut self) -> Result<(), E> { Ok(()) } }\n",
           "fn f<const N: usize>(x: [u8; N]) -> impl Fn(u8) -> u8 + '_ { let v = vec![1; 2]; match x { A::B { c, .. } | D(1..=3) if c => {} _ => return, } let Some(y) = z else { return }; if let Ok(a) = b && c {} for i in 0..n { a[i] += x.0 as u8; } |a, &b| a::<u8>(b)?.await }\n", "macro_rules! m { ($x:expr) => { $x } }\nfn g() { 'a: loop { break 'a } let s = r#\"x\"#; let c = b'\\''; unsafe { *p = S { a, ..d } } }\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  { a\ntypedef struct s { int a : 3; union { char b[2]; }; } s_t;\nstatic const char *const names[] = { [0] = \"a\", \"b\" \"c\" };\nint (*fp)(int, ...);\nenum { A, B = 1 };\n", "int f(unsigned long x, const s_t *p) {\n  for (size_t i = 0; i < sizeof(s_t); ++i) p->a[i] = (s_t){ .a = 1 }.a ? *q++ : ~x;\n  do { goto out; } while (0);\n  switch (x) { case 1: default: break; }\nout:\n  return (int)x;\n}\n"],
    "cpp": ["#include <a>\nnamespace a::b { template <typename T, int N = 3> class A final : public B<T>, private C { public: explicit A(int x) : B<T>(x), y_{x} {} virtual ~A() = default; bool operator==(const A &o) const noexcept { return true; } T y_; }; }\n",
            "auto f(std::vector<std::pair<int, int>> &&v) -> decltype(v) { for (auto &[a, b] : v) { auto g = [=, &a](auto x) mutable { return x + a; }; } try { throw X(\"y\"); } catch (const E &e) { delete[] p; } return new A<int>{1, 2}; }\nusing X = int;\nenum class E : char { A };\n", "int x = a < b ? static_cast<int>(c) : d->e.f(); std::map<int, A> m{}; void g() { std::cerr << \"a\" << b; }\n"],
    "json": ['{"a": [1, -2.5e3, true, null, {}], "b": "\\u00e9"}'],
    "yaml": ["a: 1\nb:\n- x: 1\n  y: [1, {z: 2}]\n- \"q: r\"\nc: |\n  text: {\n  more\nd: &x\n  <<: *y\n---\n- a\n"],
}
BROKEN = {
    "py": ["x = (\n", "def f()\n    pass\n", "if x:\npass\n", "print 'a'\n", "def def f(): pass\n", "x = “a”\n", "<<<<<<< a\nx = 1\n=======\n", "  x = 1\n y = 2\n", "x = 'a\n", "@@ -1 +1 @@\n", "x = 1 2\n", "function f() {}\n", "x = 0x\n", "for x in\n"],
    "js": ["function f( {", "const x = ;", "let a = 1 2", "def f():\n    pass\n", "x = `a", "<<<<<<< HEAD\nx()\n", "function f(a: string) {}", "if (a { b() }", "class A { x y }", "async async function f() {}"],
    "ts": ["interface A { x: ; }", "const x: = 1;", "function f(): { return 1 }", "func f() {}\n"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() { x := }\n", "func f() {}\n", "package a\nfunc func f() {}\n", "package a\nif x {}\n", "def f(): pass\n"],
    "java": ["class A { int x }", "class A { void f() { return 1 } }", "public int f() { return 1; }", "class A { void f() { x( ; } }", "class class A {}"],
    "rs": ["fn f( {}", "fn f() { let x = ; }", "fn fn f() {}", "struct A { x u8 }", "int f() { return 1; }"],
    "c": ["int f() { return 1 }", "int f( { }", "struct s { int a }", "int x = ;"],
    "cpp": ["class A { int x }", "int f() { return (1; }", "fn f() -> u8 { 1 }"],
    "json": ["", "{'a': 1}", '{"a": 1,}', '{"a": 1', '{"a" 1}', '"a\n"'],
    "yaml": ["a: 1\n\tb: 2\n", 'a: "x\nb: 1\n', "a: [1, 2\nb: 1\n", "a: b: c\n", "a:\n<<<<<<< x\n  b: 1\n"],
}


@pytest.mark.parametrize("ext", VALID)
def test_valid_texts_are_accepted(ext):
    for text in VALID[ext]:
        assert parsing.is_valid(text, ext, False), text


@pytest.mark.parametrize("ext", BROKEN)
def test_broken_texts_are_rejected(ext):
    for text in BROKEN[ext]:
        assert not parsing.is_valid(text, ext, False), text


@pytest.mark.parametrize("ext, open_, close", [("json", "[", "]"), ("py", "(", ")"), ("js", "[", "]"), ("ts", "(", ")"), ("jsx", "<a>", "</a>"), ("js", "`${", "}`"), ("yaml", "[", "]")])
def test_nesting_of_any_depth(ext, open_, close):
    name = {"json": "", "yaml": "a: "}.get(ext, "x = ")
    inner = "" if open_ == "<a>" else "1"
    text = name + open_ * 20_000 + "%s" + close * 20_000 + "\n"
    assert parsing.is_valid(text % inner, ext, False)
    broken = {"<a>": "</b>", "yaml": "a: b: c"}.get(open_ if open_ == "<a>" else ext, "1 2")
    assert not parsing.is_valid(text % broken, ext, False)


@pytest.mark.parametrize(
    "ext, text, fine",
    [
        ("js", "x = `a ${b + 1} c ${`in ${d}`} `;", True), ("js", "x = `a ${b + } c`;", False), ("js", "x = `${}`;", False), ("js", "x = `${a`;", False),
        ("jsx", "const a = <a>text {b.map(x => <i key={x}>{x}</i>)} it's</a>;", True), ("jsx", "const a = <a></b>;", False), ("jsx", "const a = <a>{b c}</a>;", False),
        ("jsx", "const a = <><B {...p} q=\"1\" s={`t${u}`} v/></>;", True), ("tsx", "const f = <T,>(x: T) => <B<string> x={x} />;", True),
        ("ts", "type A = `x${string}`;", True), ("ts", "type A = `x${string string}`;", False),
    ],
)
def test_expressions_in_templates_and_markup(ext, text, fine):
    assert parsing.is_valid(text, ext, False) == fine


F_STRINGS = [
    "{a}", "{a!r:>{w}} {b=} {c = !s} {{}}", "{}", "{a b}", "}", "{a!z}", "{a", "{d[\"k\"]} {f(1, b=2)}", "{a == b} {a != b} {a <= b}", "{(lambda x: x)(1)}", "{x:{y}.{z}}",
    "{x:%Y-%m-%d}", "{a if b else c}", "{*a, b}", "{yield}", "{[i for i in a]}", "{a +}", "{{a}", "{a}}", "{a:{b c}}", "{a;b}", "{a)", "{a) + (b}", "{lambda x: 1}", "{a:=5}",
    "{(a:=5)}", "{a,}", "{a[1:2]}", "{ {1: 2}[1] }", "{a!r }", "{await b}", "{a # c}", "{f\"{b}\"}", "{\"}\"}", "{a:}}", "{a!r:}", "{ }", "{=}", "{a==}", "{a=!r:^20}", "\\{a}\\n",
]


@pytest.mark.parametrize("body", F_STRINGS)
@pytest.mark.parametrize("prefix", ["f", "rf", ""])
def test_fields_of_f_strings_like_the_parser(prefix, body):
    text = f"x = {prefix}'{body}' 'more'\n"
    try:
        ast.parse(text)
        fine = True
    except SyntaxError:
        fine = False
    assert parsing.is_valid(text, "py", False) == fine


def test_where_it_stands():
    assert parsing.is_valid("    def m(self):\n        return 1\n", "py", True)
    assert parsing.is_valid("public int f() { return 1; }", "java", True) and not parsing.is_valid("public int f() { return 1; }", "java", False)
    assert parsing.is_valid("func f() {}\n", "go", True) and parsing.is_valid("get x() { return 1; }", "ts", True)
    assert parsing.is_valid("struct A { int x; };", "h", False) and parsing.is_valid("class A { int x; };", "h", False) and not parsing.is_valid("class A { int x; };", "c", False)


def test_python_grammar_like_the_parser():
    for path in (ast.__file__, random.__file__, re.__file__, pytest.__file__):
        text = open(path, encoding="utf-8").read()
        assert parsing.is_valid(text, "py", False), path
        draw = random.Random(4)
        for _ in range(15):
            cut = text[: draw.randrange(len(text))]
            try:
                ast.parse(cut)
                ok = True
            except SyntaxError:
                ok = False
            # the grammar may accept what only the compiler's later checks reject, never the other way round
            assert parsing.is_valid(cut, "py", False) >= ok


def test_unparsable_table(spark):
    rows = [("a", "x.py", "x = (", 1), ("a", "x.py", "x = (", 2), ("b", "x.py", None, 1), ("c", "x.unknown", "(", 1), ("d", "x.PY", "x = 1", 1), ("e", "x.js", "(" * 2000 + "1" + ")" * 2000, 1), ("f", None, "x", 1)]
    df = spark.createDataFrame(rows, "data_id string, path string, code string, p int")
    from pyspark.sql import functions as F

    assert [r.id for r in parsing.unparsable(df, "data_id", "path", "code", F.lit(False)).collect()] == ["a"]
    assert parsing.unparsable(df.where("false"), "data_id", "path", "code", F.lit(False)).count() == 0


HAND = "import os\n\n\ndef f(x):\n    if x:\n        return os.path\n    return [1, 2]\n"


def test_content_marks():
    H = handwritten
    assert H.content_marks(HAND, "py") == 0 and H.content_marks("", "py") == 0
    assert H.content_marks("# Code generated by tool. DO NOT EDIT.\n" + HAND, "py") == H.GENERATED
    assert H.content_marks("# Do not edit while it runs.\n# Builds the generated report; edit freely.\n" + HAND, "py") == 0
    assert H.content_marks(HAND + "# @generated by x\n", "py") == 0
    assert H.content_marks("/*\n * lib v1.2.3 | MIT | https://lib.invalid\n */\nfunction f() {}\n", "js") == H.VENDORED
    assert H.content_marks("# Copyright (c) 2026 the map team of this repository.\n" + HAND, "py") == 0
    assert H.content_marks("!function(){" + "var a=b.c(d,1);if(e){f(g)}" * 40 + "}();", "js") == H.MINIFIED
    assert H.content_marks("x = '" + "A1b2" * 300 + "'\n" + HAND, "py") == 0
    assert H.content_marks("T = [\n" + "    0x01, 0xff, 0x10,\n" * 9 + "]\n", "py") == H.DATA
    assert H.content_marks('[\n{"id": 1, "w": 0.5},\n' + '{"id": 2, "w": 0.1},\n' * 20 + "{}]", "json") == H.DATA
    assert H.content_marks('{"port": 1, "hosts": ["a"]}', "json") == 0
    assert H.content_marks("A = 1\nB = 'x'\nC = [1, 2]\nD = None\n", "py") == 0


def test_marks_behind_long_comments():
    licence = "".join(f"# {i} Redistribution in source and binary forms is allowed if the notice above stays.\n" for i in range(300))
    assert handwritten.content_marks(licence + HAND, "py") == 0
    assert handwritten.content_marks(licence + "# Code generated by tool. DO NOT EDIT.\n" + HAND, "py") == handwritten.GENERATED
    assert handwritten.content_marks("/*\n" + licence + "*/\n/*! lib v1.2.3 | MIT */\n" + "f();\n", "js") == handwritten.VENDORED
    assert handwritten.content_marks("# " + "generated by hand, " + "a b " * 100_000 + "\n" + HAND, "py") == 0


def test_inline_source_map():
    text = HAND.replace("#", "//") + "//# sourceMappingURL=data:application/json;base64," + BODY * 200
    assert handwritten.content_marks(text + "\n\n", "js") == handwritten.MINIFIED
    assert handwritten.content_marks(text + "\nx()\n", "js") == 0


def test_not_handwritten_table(spark):
    from pyspark.sql import functions as F

    lib = "".join(f"    value_{i} = compute_thing_{i}(argument, {i})\n" for i in range(30))
    rows = [
        ("path", "r1", "node_modules/lib/a.py", "file", "def f():\n" + lib), ("edited", "r2", "src/a.py", "file", "def g():\n" + lib.replace("value_3", "other_3")),
        ("unit", "r2", "src/a.py", "function", "def g(): pass"), ("own", "r1", "src/a.py", "file", "def f():\n" + lib), ("hand", "r3", "src/b.py", "file", HAND),
        ("decoy", "r3", "src/generated_reports/vendors/b.py", "file", HAND), ("gen", "r3", "src/x_pb2.py", "file", HAND), ("min", "r3", "a.min.js", "file", "x"),
        ("settings", "r3", "generated/a.json", "file", "{}"), ("null", "r3", "node_modules/a/b.py", "file", None), ("nulls", None, None, None, "x"), ("gen", "r3", "src/x_pb2.py", "file", HAND),
    ]
    df = spark.createDataFrame(rows, "data_id string, repo string, path string, unit_type string, code string")
    whole = F.coalesce(F.col("unit_type") == "file", F.lit(False))
    out = {r.id: r.marks for r in handwritten.not_handwritten(df, "data_id", F.col("repo"), "path", whole, "code").collect()}
    assert out == {"path": 4, "edited": 4, "unit": 4, "gen": 1, "min": 2}
    assert handwritten.not_handwritten(df.where("false"), "data_id", F.col("repo"), "path", whole, "code").count() == 0


def test_marks_of_chunked_files(spark):
    from pyspark.sql import functions as F

    dense, table = "!function(){" + "var a=b.c(d,1);if(e){f(g)}" * 40 + "}();", "    0x01, 0xff, 0x10,\n" * 60
    lib = ["\n".join(f"value_{i}_{k} = compute_thing_{i}(argument, {k})" for i in range(30)) for k in range(2)]
    files = {
        "gen.py": ["# Code generated by tool. DO NOT EDIT.\n" + HAND, HAND, HAND], "late.py": [HAND, "# Code generated by tool. DO NOT EDIT.\n" + HAND, HAND],
        "banner.js": ["/*! lib v1.2.3 | MIT */\nf();\n", "g();\n"], "map.js": ["f();\n" * 9, "g();\n//# sourceMappingURL=x.map\n"],
        "dense.js": [dense, dense, "f();\n"], "mixed.js": [dense, HAND * 20], "data.py": ["T = [\n" + table, table, "]\n" + HAND], "some.py": ["T = [\n" + table + "]\n", HAND * 20],
        "copy.py": [lib[0], lib[1], HAND], "node_modules/l/a.py": lib,
    }
    rows = [(f"{p} {n}", "r0" if "modules" in p else "r1", p, n, x) for p, parts in files.items() for n, x in enumerate(parts, 1)]
    rows += [("of gen", "r1", "gen.py", None, HAND), ("other repo", "r2", "gen.py", None, HAND)]
    df = spark.createDataFrame(rows + rows[:1], "data_id string, repo string, path string, part int, code string")
    marks = handwritten.not_handwritten(df, "data_id", F.col("repo"), "path", F.lit(False), "code", part=F.col("part"))
    got = {r.id: r.marks for r in marks.collect()}
    every = {"gen.py": 1, "banner.js": 4, "map.js": 2, "dense.js": 2, "data.py": 8, "copy.py": 4, "node_modules/l/a.py": 4}
    want = {f"{p} {n}": m for p, m in every.items() for n in range(1, len(files[p]) + 1)} | {"of gen": 1, "late.py 2": 1, "mixed.js 1": 2, "some.py 1": 8}
    assert got == want


def test_popular_library_and_idioms(spark):
    from pyspark.sql import functions as F

    lib = [f"value_{i} = compute_thing_{i}(argument, {i})" for i in range(20)]
    idiom = ["if __name__ == '__main__':", "logger = logging.getLogger(__name__)", "parser = argparse.ArgumentParser()", "arguments = parser.parse_args()", "sys.exit(main(arguments))"]
    own = lambda n, k: [f"own_{n}_{i} = something_else_{n}({i})" for i in range(k)]
    rows = [("lib", "r0", "vendor/lib/a.py", "\n".join(lib + idiom))]
    # many edited copies; many files that share the idioms only, most of one of them idioms; a copy of 3 of 5 lines that are none
    rows += [(f"copy{n}", f"c{n}", "src/a.py", "\n".join(lib[: 16 + n % 4] + own(n, 4))) for n in range(60)]
    rows += [(f"hand{n}", f"h{n}", "src/b.py", "\n".join(idiom + own(n, 30))) for n in range(60)]
    rows += [("short", "s0", "src/c.py", "\n".join(idiom + own(900, 3))), ("most", "s1", "src/d.py", "\n".join(idiom + lib[:6] + own(901, 4)))]
    rows += [("less", "s2", "src/e.py", "\n".join(idiom + lib[:6] + own(902, 5)))]
    df = spark.createDataFrame([(*r, "function") for r in rows], "data_id string, repo string, path string, code string, unit_type string")
    got = {r.id for r in handwritten.not_handwritten(df, "data_id", F.col("repo"), "path", F.lit(False), "code").collect()}
    # by brute force: idioms left out of numerator and denominator
    lines = {i: set(code.split("\n")) - set(idiom) for i, _, _, code in rows}
    want = {i for i, x in lines.items() if len(x & set(lib)) >= max(5, 0.6 * len(x))}
    assert got == want and {"copy0", "copy59", "most"} <= got and not {"short", "less", "hand0"} & got


def test_encoding_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    texts = ["", None, " ", "\n\n  a", "Hello's world  42!", "<|endoftext|>", "é ̈ 漢字 🎉\x1c\u2003x", "a" * 5000, "word " * 3000, "Hello's world  42!"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, block int")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df, block_chars=4000).collect()}
    plain = tokenizers.Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert got == {i: plain.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in encoding.decode_corpus(encoding.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encoding.encode_corpus(df.where("false")).count() == 0
    again = spark.createDataFrame([(1, "hello"), (1, "text world"), (2, None), (2, "")], "doc_id bigint, text string")
    coded = encoding.encode_corpus(again).unionByName(spark.createDataFrame([(3, None), (4, [70_000, -1, None])], "doc_id bigint, ids array<int>"))
    assert sorted((r.doc_id, r.text) for r in encoding.decode_corpus(coded).collect()) == [(1, "hello"), (1, "text world"), (2, ""), (2, ""), (3, ""), (4, "")]


def test_leaks_like_brute_force(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = {i: " ".join(draw.choices(words, k=draw.randint(8, 30))) for i in range(20)}
    items |= {20: None, 21: "", 22: items[3], 23: "short one"}
    docs = {}
    for i in range(60):
        base = draw.choices(words, k=draw.randint(0, 60))
        cut = (items[draw.randrange(20)] or "").split()
        start = draw.randrange(0, max(1, len(cut) - 11))
        part = [w.upper() if draw.random() < 0.2 else w for w in cut[start : start + draw.randint(9, 16)]]
        docs[i] = " - ".join(base[:20] + part + base[20:])
    docs |= {60: None, 61: "", 62: "...", 63: " ".join(draw.choices(words, k=20_000)) + " " + items[0]}
    runs = {k: (lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)})(leaks.words_of(t or "")) for k, t in items.items()}
    want = {(d, k) for d, t in docs.items() for w in [leaks.words_of(t or "")] for k, r in runs.items() if any(tuple(w[i : i + 12]) in r for i in range(len(w) - 11))}
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(0, docs[0], 2)], "doc_id bigint, text string, item_id bigint")
    other = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = leaks.leaked_passages(df, other).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.verbatim} == want and want
    assert all(r.similarity == 1.0 for r in found if r.verbatim)
    assert leaks.leaked_passages(df.where("false"), other).count() == leaks.leaked_passages(df, other.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_near_passages_like_brute_force(spark, radius):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = {i: draw.choices(words, k=draw.randint(12, 25)) for i in range(12)}
    docs = {}
    for i in range(60):
        part = list(items[i % 12])
        # words that change places keep the fingerprint, other words change it a little
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(part) - 1)
            part[at], part[at + 1] = part[at + 1], part[at]
        if draw.random() < 0.4:
            part[draw.randrange(len(part))] = draw.choice(words)
        docs[i] = draw.choices(words, k=10) + part + draw.choices(words, k=10)
    known = leaks._Words()
    cut = lambda w: list(zip([w[i : i + 12] for i in range(len(w) - 11)], leaks.fingerprints(known.bits(w), 12).tolist()))
    want = {}
    for d, w in docs.items():
        for k, v in items.items():
            near = [leaks.shingle_similarity(a, b) for a, p in cut(w) for b, q in cut(v) if (p ^ q).bit_count() <= radius]
            if near and max(near) >= 0.5:
                want[d, k] = max(near)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id bigint, text string")
    other = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.leaked_passages(df, other, radius=radius, similarity=0.5).collect()}
    assert got == want and any(x < 1 for x in want.values())


def test_block_keys_meet_within_the_radius():
    import numpy as np

    draw = random.Random(7)
    for radius in (0, 1, 2, 4):
        one = np.array([draw.getrandbits(64) for _ in range(200)], np.uint64)
        other = np.array([int(x) ^ sum(1 << i for i in draw.sample(range(64), radius)) for x in one], np.uint64)
        a, b = leaks.block_keys(one, radius), leaks.block_keys(other, radius)
        assert (a == b).any(axis=0).all() and a.shape[0] == (radius + 2) * (radius + 1) // 2


@pytest.mark.parametrize("count", [0, 3, 20_000])
def test_filters_lose_nothing(spark, count):
    import numpy as np

    from skillweave.llm import bloom

    draw = np.random.default_rng(count)
    keys = draw.integers(-(1 << 63), 1 << 63, count, np.int64)
    other = draw.integers(-(1 << 63), 1 << 63, 50_000, np.int64).view(np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys], "key bigint")
    for most, share in ((28, 0.01), (16, 1.0)):
        words = bloom.filter_of(df, most)
        assert len(words) * 64 <= 1 << most
        assert len(bloom.passing(words, keys.view(np.uint64))) == count
        assert len(bloom.passing(words, other)) <= share * len(other)


def brute_spans(docs: dict[int, str], length: int) -> set[tuple[int, int, int]]:
    where: dict[str, set[int]] = {}
    for k, t in docs.items():
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in docs.items():
        at = [i for i in range(len(t or "") - length + 1) if len(where[t[i : i + length]]) > 1]
        begin = None
        for i, j in zip(at, at[1:] + [10**9]):
            begin = i if begin is None else begin
            if j > i + length:
                out.add((k, begin, i + length))
                begin = None
    return out


@pytest.mark.parametrize("crowd", [0, 64])
def test_shared_spans_like_brute_force(spark, crowd):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choices("abcdefgh é🎉", k=n))
    common, other = text(300), text(90)
    docs: dict[int, str | None] = {i: text(draw.randint(0, 200)) + common[draw.randrange(0, 150) :][: draw.randint(20, 150)] + text(40) for i in range(40)}
    docs |= {100 + i: other + text(50) for i in range(12)}
    docs |= {200: None, 201: "", 202: "short", 203: common * 3, 204: common, 205: common, 206: "x" * 400, 207: "x" * 90, 208: text(20_000) + other, 209: "ab" * 300, 210: "ab" * 200}
    df = spark.createDataFrame([(k, t, 0) for k, t in docs.items()] + [(203, docs[203], 1)], "doc_id bigint, text string, key bigint")
    got = {tuple(r) for r in spans.shared_spans(df, length=60, gram=12, crowd=crowd).collect()}
    assert got == brute_spans(docs, 60) and got
    assert spans.shared_spans(df.where("false"), length=60, gram=12).count() == 0
