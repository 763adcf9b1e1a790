import pytest
from kelpie.operators import dom
from kelpie.operators.jslex import read_literals


def literals(source):
    got = read_literals(source)
    return got["error"] if got["error"] else [(x["value"], x["key_name"]) for x in got["literals"]]


CASES = {
    'const a = "x", b = {k: "y", "z": ["w"]}, {c = "q"} = f("r");': [("x", "a"), ("y", "b"), ("z", "b"), ("w", "b"), ("r", None)],
    'a.b = "x"; process.env.K = `t`; q["no"] = "yes"': [("x", None), ("t", None), ("yes", None)],
    'class A { f = "x"; #p = "y"; ["c"] = "z"; static s = g("u"); m(a = "d") { return "e" } }': [("x", "f"), ("y", "p"), ("z", None), ("u", None), ("d", None), ("e", None)],
    'const n = new Foo("x"); const c = foo("y").bar("z"); "abc".concat("d")': [("x", "n"), ("y", None), ("z", None), ("abc", None), ("d", None)],
    'import x from "m"; export {y} from "n"; export default "d"': [("m", None), ("n", None), ("d", None)],
    "const r = /[\"']/g, s = a / b / \"c\"; if (x) /q\"/.test(y)": [("c", "s")],
    'const f = (a = "p") => ({k: `t${"in"}`}), g = async x => { await "w" }': [("p", "f"), ("in", "f"), ("w", "g")],
    'const k = cond ? "a\\x41\\u{1F600}\\\nq" : `l1\\n`': [("aA😀q", "k"), ("l1\n", "k")],
    "`a${`b${'c'}`}d`": [("c", None)],
    'for (const [a, b] of m) { switch (a) { case "u": break; default: z("v") } }': [("u", None), ("v", None)],
    "": [],
}


@pytest.mark.parametrize("source", CASES)
def test_names(source):
    assert literals(source) == CASES[source]


#: Valid scripts, one a line.
SYNTAX = r"""
if(!new.target) throw "a"; var k="b"
function F(){ return new.target.name + "x" }
new new X("a")("b")
import.meta.url + "x"
const m = await import("mod")
label: for(;;){ break label }
a?.b?.["c"]?.("d")
x ??= "y"; x ||= "z"; x &&= "w"; x **= 2
class A { static { this.x = "s" } get a(){return "g"} set a(v){} static async *gen(){ yield "y" } #p(){ } static #q = "q"; "str"(){ } 12(){ } async(){ } get(){ } static(){ } }
class B extends A { constructor(){ super("a"); super.m("b") } }
const {a: {b = "x"} = {}, ...rest} = o
const [x = "1", , y] = z
async function* g(){ for await (const x of y) yield* x }
var f = async function named() {}
var o = { async a(){}, get b(){ return "x" }, set b(v){}, *c(){}, async *d(){}, [`k${1}`]: "v", "q": 1, 3: "t", get: "g", set: "s", async: "as", static: "st", new: 1, class: "c", ...sp }
var re = /[/\]]+/gi, d = a / b / c
var t = tag`a${b}c`, u = `x${`y${"z"}`}`
if (a) b; else c
do x++; while(x<5)
with(a){ b }
switch(x){ case "a": case "b": { } default: }
try { } catch { } finally { }
try { } catch ({message}) { }
export default class {}
export default function(){}
export * as ns from "m"; export * from "n"; export { default } from "x"; export { a as b, c as "d" }
import d, * as ns from "m"; import {a as b, default as c} from "n"; import "side"; import json from "./x.json" with { type: "json" }
var n = 0x1F + 0b11 + 0o17 + 1_000 + 1e-5 + .5 + 5. + 10n
a = b ? c : d ? "e" : "f"
(function(){})(), (() => {})(), !function(){}(), void 0
var let_ = 1; let async; async = 1; var of = 2; var get = 3
for (var i = 0, n = a.length; i < n; i++) ;
for (const k in o) if (o.hasOwnProperty(k)) continue
x = a in b, y = a instanceof B, z = typeof a === "undefined", delete a.b
#!/usr/bin/env node
"use strict"; var a = "x"
<!-- html comment
var a = 1 /* c */ // d
return_ = x => ({}), y => {}, (a, b = "c", ...r) => a
async x => await x; async (x) => { await "y" }
var abc = "esc"; var ünï = "u"
a = b
++c
a = b
/re/g.exec("x")
throw new Error("m")
debugger; ;;
let x; { let x = "y" }
if (a) function f(){}
x = function* (){ yield; yield "a"; const b = yield }
a = { __proto__: null, "a-b": "c" }
var fn = ({a, b: {c}}, [d, e] = ["f"]) => {}
a?.5:1
x = a ? .5 : "b"
x = y => z => "w"
obj.class.new.if = "k"
a = b, c = d
!(a in b) && (c = "d")
x = `\``
x = '\u{1F600}\x41\101'
var yield_ = 1, await_ = 2; var await = 3
class C { 'a' = "b"; [x] = "y"; static async = 1; get; set; static; async }
class D { accessor = 1; static get x(){ return 1 } static set x(v){} static async y(){} }
x = class Named extends (a, b) {}
x = /(?<y>a)[\]/]/u.test(s) ? "t" : "f"
x = a++ / 2; y = (a) / 2; z = a[0] / 2; w = f() / 2
if (/x/.test(a)) /y/.test(b)
x = { a } / 2
"""


@pytest.mark.parametrize("source", SYNTAX.strip("\n").split("\n"))
def test_valid_syntax_is_read(source):
    assert isinstance(literals(source), list)


def test_new_target():
    assert literals('if (!new.target) throw "a"; var k = "b"; var n = new.target.x("c"), m = new new X("d")("e")') == [("a", None), ("b", "k"), ("c", None), ("d", "m"), ("e", "m")]


@pytest.mark.parametrize("source", ['let s = "open', "x = {", "`a${b", "/* open", "a ) b", "x = /open", "[1, 2"])
def test_scripts_that_do_not_parse(source):
    assert isinstance(literals(source), str)


def test_spans_are_bytes_from_the_quote():
    got = read_literals('var é = "ü", b = "x"')["literals"]
    assert [(x["span_start"], x["span_end"]) for x in got] == [(9, 13), (19, 22)]


def elements(html):
    return [(e["kind"], e["href"], e["type"], e["body"]) for e in dom.walk(html)]


def test_elements():
    html = '<a href=" /x ">a</a><script src="a.js"></script><script type="module">q</script><SCRIPT>var t = "</p>";</SCRIPT><a>no</a><script>  </script>'
    assert elements(html) == [("link", " /x ", None, None), ("remote", "a.js", None, None), ("embedded", None, "module", "q"), ("embedded", None, None, 'var t = "</p>";'), ("embedded", None, None, "")]
    assert elements(None) == [] and elements("") == []


def test_links_and_scripts(spark):
    html = (
        '<a href="https://o.com/p">1</a><a href="rel">2</a><a href="/root">3</a><a href="#top">4</a><a href="mailto:a@b">5</a><a href="javascript:x">6</a><a href="/i.jpg?id=1">7</a><a href="  ">8</a>'
        '<script src="s.js"></script><script type="application/json">{}</script><script type="text/javascript"> x </script><script src="https://unpkg.com/u.js"></script><script> </script>'
    )
    table = dom.extract_dom(spark.createDataFrame([("https://a.b/deep/page", html), ("https://a.b/2", html), (None, None)], "url string, html string"))
    links = dom.page_links(table).where("page_url = 'https://a.b/2'").orderBy("ordinal")
    assert [r.url for r in links.collect()] == ["https://o.com/p", "https://a.b/rel", "https://a.b/root"]
    scripts = dom.page_scripts(table)
    assert scripts.count() == 6
    rows = dom.distinct_scripts(dom.wanted_scripts(scripts)).collect()
    assert sorted((r.kind, r.script_url, r.source) for r in rows) == sorted([("url", "https://a.b/s.js", None), ("embedded", None, "x"), ("embedded", None, "x")], key=str) or sorted(
        (r.kind, str(r.script_url), str(r.source)) for r in rows
    ) == [("embedded", "None", "x"), ("embedded", "None", "x"), ("url", "https://a.b/s.js", "None")]
