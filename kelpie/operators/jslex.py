"""String literals of JavaScript and the identifier each is bound to.

A lenient recursive-descent reader: it follows statements and expressions far enough to know, for every string,
which name it belongs to, and fails on what no engine would accept (unclosed strings, templates, comments,
brackets). A script that fails gives an error and no literals.

Names: `x = "..."` in a declaration gives x; a plain assignment clears the name and only its right side is read; a
class field gives its key; a call clears the name inside its callee and arguments; everything else (properties,
functions, new, arrays) keeps the name around it. Templates count only without substitutions; expressions inside
substitutions are read.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<literals:array<struct<ordinal:int,kind:string,value:string,key_name:string,span_start:int,span_end:int>>,error:string>"
SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n]*)+", re.S)
IDENT = re.compile(r"(?:[^\W\d]|[$_\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
REGEX = re.compile(r"/(?:[^\\/\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[\w$]*")
STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|.))*{q}", re.S) for q in "'\""}
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-3]?[0-7]{1,2})|(\r\n|.))", re.S)
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** == != === !== < > <= >= << >> >>> & | ^ && || ??".split())
PREFIX = frozenset("! ~ + - ++ --".split())
WORD_PREFIX = frozenset("typeof void delete await".split())
NOT_OPERAND = frozenset("in instanceof else case default catch finally do while".split())


class ScriptError(ValueError):
    """The script can't be read."""


@dataclass(slots=True)
class Token:
    kind: str  # ident, string, number, punct, template, end
    text: str
    start: int
    end: int
    newline: bool


def cook(body: str) -> str:
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        if m[1] or m[2] or m[3]:
            return chr(min(int(m[1] or m[2] or m[3], 16), 0x10FFFF))
        if m[4]:
            return chr(int(m[4], 8))
        return SIMPLE.get(m[5], m[5])

    # escaped surrogates are joined where they pair, and replaced where they do not
    return ESCAPE.sub(one, body).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Reader:
    def __init__(self, source: str) -> None:
        self.s, self.out, self.name = source, [], None
        self.token = self.lex(0)

    # tokens

    def lex(self, at: int) -> Token:
        s = self.s
        newline = False
        if m := SPACE.match(s, at):
            newline = "\n" in m[0] or "\r" in m[0]
            at = m.end()
        if at >= len(s):
            return Token("end", "", at, at, newline)
        if s.startswith("/*", at):
            raise ScriptError(f"unclosed comment at {at}")
        if s.startswith("#!", at) and at == 0:
            return self.lex(s.find("\n") + 1 or len(s))
        c = s[at]
        if c in "'\"":
            m = STRING[c].match(s, at)
            if not m:
                raise ScriptError(f"unclosed string at {at}")
            return Token("string", m[0], at, m.end(), newline)
        if c == "`":
            return Token("template", c, at, at + 1, newline)
        if m := IDENT.match(s, at):
            return Token("ident", m[0], at, m.end(), newline)
        if c.isdigit() or (c == "." and s[at + 1 : at + 2].isdigit()):
            m = NUMBER.match(s, at)
            if m:
                return Token("number", m[0], at, m.end(), newline)
        if m := PUNCT.match(s, at):
            return Token("punct", m[0], at, m.end(), newline)
        raise ScriptError(f"unexpected {c!r} at {at}")

    def next(self) -> Token:
        t = self.token
        self.token = self.lex(t.end)
        return t

    def at(self, text: str) -> bool:
        return self.token.text == text and self.token.kind in ("punct", "ident")

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.eat(text):
            raise ScriptError(f"expected {text} at {self.token.start}")

    def emit(self, kind: str, value: str, start: int, end: int) -> None:
        self.out.append([kind, value, self.name, start, end])

    def string(self) -> Token:
        t = self.next()
        self.emit("string", cook(t.text[1:-1]), t.start, t.end)
        return t

    # statements

    def program(self) -> None:
        while self.token.kind != "end":
            self.statement()

    def block(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.token.kind == "end":
                raise ScriptError("unclosed block")
            self.statement()
        self.next()

    def statement(self) -> None:
        t = self.token
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return None
            if t.text == "@":
                self.next()
                self.unary()
                return None
            if t.text in (")", "]", "}"):
                raise ScriptError(f"unexpected {t.text} at {t.start}")
        elif t.kind == "ident":
            method = getattr(self, f"on_{t.text}", None)
            if method:
                return method()
            after = self.lex(t.end)
            if after.text == ":" and after.kind == "punct":
                self.next()
                self.next()
                return None
        self.expression()
        return self.end_statement()

    def end_statement(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.token.kind == "end" or self.token.newline):
            raise ScriptError(f"unexpected {self.token.text!r} at {self.token.start}")

    def on_var(self) -> None:
        self.declarations()
        self.end_statement()

    on_const = on_var

    def on_let(self) -> None:
        after = self.lex(self.token.end)
        if after.kind == "ident" and after.text not in ("in", "of", "instanceof") or after.text in ("[", "{"):
            return self.on_var()
        self.expression()
        return self.end_statement()

    def declarations(self) -> None:
        self.next()
        while True:
            bound = self.binding()
            if self.eat("="):
                outer, self.name = self.name, bound
                self.assignment()
                self.name = outer
            if not self.eat(","):
                return

    def binding(self) -> str | None:
        """The name bound, None for a pattern, whose insides are passed over."""
        if self.token.kind == "ident":
            return self.next().text
        mark = len(self.out)
        if self.at("{") or self.at("["):
            self.primary()
            del self.out[mark:]
            return None
        raise ScriptError(f"a name is missing at {self.token.start}")

    def on_function(self) -> None:
        self.function()

    def on_async(self) -> None:
        after = self.lex(self.token.end)
        if after.text == "function" and not after.newline:
            self.next()
            return self.function()
        self.expression()
        return self.end_statement()

    def function(self) -> None:
        self.expect("function")
        self.eat("*")
        if self.token.kind == "ident":
            self.next()
        self.parameters()
        self.block()

    def parameters(self) -> None:
        self.expect("(")
        while not self.at(")"):
            self.eat("...")
            self.binding_with_default()
            if not self.eat(","):
                break
        self.expect(")")

    def binding_with_default(self) -> None:
        if self.token.kind == "ident":
            self.next()
        else:
            self.primary()
        if self.eat("="):
            self.assignment()

    def on_class(self) -> None:
        self.class_()

    def class_(self) -> None:
        self.expect("class")
        if self.token.kind == "ident" and self.token.text != "extends":
            self.next()
        if self.eat("extends"):
            self.unary()
        self.expect("{")
        while not self.eat("}"):
            if self.token.kind == "end":
                raise ScriptError("unclosed class")
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.eat("@"):
            self.unary()
            return
        # modifiers are names where nothing that could be a member's key follows
        while self.token.kind == "ident" and self.token.text in ("static", "async", "get", "set", "accessor"):
            after = self.lex(self.token.end)
            if self.token.text == "static" and after.text == "{":
                self.next()
                return self.block()
            if after.kind in ("ident", "string", "number") or after.text in ("[", "#", "*"):
                self.next()
                continue
            break
        self.eat("*")
        mark = len(self.out)
        key = self.key()
        if self.at("("):
            self.parameters()
            return self.block()
        del self.out[mark:]
        if self.eat("="):
            outer, self.name = self.name, key
            self.assignment()
            self.name = outer
        return self.end_statement()

    def key(self) -> str | None:
        """Reads a property or member key; its name where it is an identifier or a computed one."""
        t = self.token
        if t.kind == "ident":
            return self.next().text
        if t.kind == "string":
            self.string()
            return None
        if t.kind == "number":
            self.next()
            return None
        if self.eat("#"):
            return self.next().text
        if self.eat("["):
            mark = self.token.start
            self.assignment()
            text = self.s[mark : self.token.start].strip()
            self.expect("]")
            m = re.fullmatch(r"(?:[\w$]+\.)*([\w$]+)|(?:[\w$]+\.)*[\w$]+\[[\"']([^\"']*)[\"']\]", text)
            return (m[1] or m[2]) if m and not text[:1].isdigit() else None
        raise ScriptError(f"a key is missing at {t.start}")

    def header(self) -> None:
        """The parenthesis after if, while, for, switch, with and catch."""
        self.expect("(")
        while not self.at(")"):
            if self.token.kind == "end":
                raise ScriptError("unclosed parenthesis")
            if self.eat(";"):
                continue
            if self.token.text in ("var", "const", "let") and self.token.kind == "ident":
                self.declarations()
            else:
                self.expression()
            if self.eat("of") or self.eat("in"):
                self.expression()
        self.next()

    def on_if(self) -> None:
        self.next()
        self.header()
        self.statement()
        if self.eat("else"):
            self.statement()

    def on_while(self) -> None:
        self.next()
        self.header()
        self.statement()

    on_with = on_while

    def on_for(self) -> None:
        self.next()
        self.eat("await")
        self.header()
        self.statement()

    def on_do(self) -> None:
        self.next()
        self.statement()
        self.expect("while")
        self.header()
        self.eat(";")

    def on_switch(self) -> None:
        self.next()
        self.header()
        self.block()

    def on_case(self) -> None:
        self.next()
        self.expression()
        self.expect(":")

    def on_default(self) -> None:
        self.next()
        self.expect(":")

    def on_try(self) -> None:
        self.next()
        self.block()
        if self.eat("catch"):
            if self.at("("):
                self.header()
            self.block()
        if self.eat("finally"):
            self.block()

    def on_return(self) -> None:
        self.next()
        if not (self.at(";") or self.at("}") or self.token.kind == "end" or self.token.newline):
            self.expression()
        self.end_statement()

    on_throw = on_return

    def on_break(self) -> None:
        self.next()
        if self.token.kind == "ident" and not self.token.newline:
            self.next()
        self.end_statement()

    on_continue = on_break

    def on_debugger(self) -> None:
        self.next()
        self.end_statement()

    def on_import(self) -> None:
        after = self.lex(self.token.end)
        if after.text in ("(", "."):
            self.expression()
            return self.end_statement()
        self.next()
        return self.module_names()

    def on_export(self) -> None:
        self.next()
        if self.eat("default"):
            if self.token.text in ("function", "class", "async"):
                return self.statement()
            self.assignment()
            return self.end_statement()
        if self.at("{") or self.at("*"):
            return self.module_names()
        return self.statement()

    def module_names(self) -> None:
        """Names and sources of an import or export, up to its end."""
        while not (self.at(";") or self.token.kind == "end"):
            if self.token.kind == "string":
                self.string()
                if not (self.at("with") or self.at("assert") or self.at("as") or self.at(",") or self.at("}")):
                    break
            elif self.token.kind in ("ident", "punct") and (self.token.kind == "ident" or self.token.text in "{},*:"):
                closing = self.at("}")
                self.next()
                if closing and self.token.text not in ("from", "with", "assert", ",", "}"):
                    break
            else:
                raise ScriptError(f"unexpected {self.token.text!r} at {self.token.start}")
        self.end_statement()

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        if self.at("yield"):
            self.next()
            self.eat("*")
            if not self.token.newline and self.token.text not in (")", "]", "}", ",", ";", ":", "in", "of") and self.token.kind != "end":
                self.assignment()
            return
        if self.at("async"):
            after = self.lex(self.token.end)
            if after.kind == "ident" and after.text not in NOT_OPERAND and after.text != "function" and not after.newline:
                self.next()
        mark = len(self.out)
        self.binary()
        if self.eat("?"):
            self.assignment()
            self.expect(":")
            self.assignment()
        elif self.at("=>"):
            self.next()
            for r in self.out[mark:]:
                r[2] = self.name  # defaults of parameters keep the name around the function
            if self.at("{"):
                self.block()
            else:
                self.assignment()
        elif self.token.kind == "punct" and self.token.text in ASSIGN:
            self.next()
            del self.out[mark:]
            outer, self.name = self.name, None
            self.assignment()
            self.name = outer

    def binary(self) -> None:
        self.unary()
        while True:
            t = self.token
            if t.kind == "punct" and t.text in BINARY:
                self.next()
            elif t.kind == "ident" and t.text == "instanceof":
                self.next()
            elif t.kind == "ident" and t.text == "in":
                self.next()
            else:
                return
            self.unary()

    def unary(self) -> None:
        while (self.token.kind == "punct" and self.token.text in PREFIX) or (self.token.kind == "ident" and self.token.text in WORD_PREFIX):
            if self.token.kind == "ident":
                after = self.lex(self.token.end)
                if after.text in ("=>", ",", ")", ";", ".", "=", ":", "]", "}") and after.kind == "punct" or after.kind == "end":
                    break
            self.next()
        self.postfix()

    def postfix(self) -> None:
        mark = len(self.out)
        made = 0
        if self.at("new"):
            while self.eat("new"):
                made += 1
                if self.at("."):
                    # new.target is a value of its own
                    self.next()
                    if self.next().text != "target":
                        raise ScriptError(f"target is missing at {self.token.start}")
                    made -= 1
                    break
            else:
                self.primary()
        else:
            self.primary()
        while True:
            if self.at(".") or self.at("?."):
                self.next()
                if self.at("("):
                    self.call(mark)
                elif self.at("["):
                    self.index()
                elif self.token.kind == "template":
                    self.template()
                else:
                    self.eat("#")
                    if self.next().kind != "ident":
                        raise ScriptError(f"a property is missing at {self.token.start}")
            elif self.at("["):
                self.index()
            elif self.at("("):
                if made:
                    # the arguments of new keep the name
                    self.arguments()
                    made -= 1
                else:
                    self.call(mark)
            elif self.token.kind == "template":
                self.template()
            elif (self.at("++") or self.at("--")) and not self.token.newline:
                self.next()
            else:
                return

    def call(self, mark: int) -> None:
        # async (x) => ... and calls look alike up to the arrow; a call clears the name in callee and arguments
        for r in self.out[mark:]:
            r[2] = None
        outer, self.name = self.name, None
        self.arguments()
        self.name = outer

    def arguments(self) -> None:
        self.expect("(")
        self.items(")")

    def index(self) -> None:
        self.expect("[")
        self.expression()
        self.expect("]")

    def items(self, close: str) -> None:
        while not self.eat(close):
            if self.token.kind == "end":
                raise ScriptError(f"{close} is missing")
            if self.eat(","):
                continue
            self.eat("...")
            self.assignment()
            if not self.at(close):
                self.expect(",")

    def primary(self) -> None:
        t = self.token
        if t.kind == "string":
            self.string()
        elif t.kind == "number":
            self.next()
        elif t.kind == "template":
            self.template()
        elif t.kind == "ident":
            if t.text == "function":
                self.function()
            elif t.text == "class":
                self.class_()
            elif t.text == "async" and self.lex(t.end).text == "function":
                self.next()
                self.function()
            elif t.text in NOT_OPERAND:
                raise ScriptError(f"unexpected {t.text} at {t.start}")
            else:
                self.next()
        elif t.kind == "punct" and t.text == "(":
            self.next()
            self.items(")")
        elif t.kind == "punct" and t.text == "[":
            self.next()
            self.items("]")
        elif t.kind == "punct" and t.text == "{":
            self.object()
        elif t.kind == "punct" and t.text in ("/", "/="):
            m = REGEX.match(self.s, t.start)
            if not m:
                raise ScriptError(f"unclosed regular expression at {t.start}")
            self.token = self.lex(m.end())
        elif t.kind == "punct" and t.text == "#":
            self.next()
            self.next()
        elif t.kind == "punct" and t.text == "@":
            self.next()
            self.unary()
        else:
            raise ScriptError(f"unexpected {t.text or 'end'!r} at {t.start}")

    def object(self) -> None:
        self.expect("{")
        while not self.eat("}"):
            if self.token.kind == "end":
                raise ScriptError("} is missing")
            if self.eat(","):
                continue
            if self.eat("..."):
                self.assignment()
                continue
            while self.token.kind == "ident" and self.token.text in ("async", "get", "set"):
                after = self.lex(self.token.end)
                if after.kind in ("ident", "string", "number") or after.text in ("[", "*", "#"):
                    self.next()
                else:
                    break
            self.eat("*")
            self.key()
            if self.at("("):
                self.parameters()
                self.block()
            elif self.eat(":"):
                self.assignment()
            elif self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.expect(",")

    def template(self) -> None:
        start = self.token.start
        at, plain = start + 1, True
        s, n = self.s, len(self.s)
        while True:
            if at >= n:
                raise ScriptError(f"unclosed template at {start}")
            c = s[at]
            if c == "\\":
                at += 2
            elif c == "`":
                break
            elif c == "$" and s.startswith("${", at):
                plain = False
                self.token = self.lex(at + 2)
                self.expression()
                if not self.at("}"):
                    raise ScriptError(f"unclosed substitution at {at}")
                at = self.token.end
            else:
                at += 1
        if plain:
            self.emit("template", cook(s[start + 1 : at].replace("\r\n", "\n")), start, at + 1)
        self.token = self.lex(at + 1)


def read_literals(source: str | None) -> dict:
    """Literals of a script in order, or an error. Spans are byte offsets and start at the opening quote."""
    if not source:
        return {"literals": [], "error": None}
    try:
        r = Reader(source)
        r.program()
    except (ScriptError, RecursionError) as e:
        return {"literals": [], "error": str(e) or type(e).__name__}
    out = sorted(r.out, key=lambda x: x[3])
    plain = source.isascii()
    offset, seen, rows = 0, 0, []
    for k, (kind, value, name, start, end) in enumerate(out):
        if plain:
            a, b = start, end
        else:
            offset += len(source[seen:start].encode())
            seen = start
            a, b = offset, offset + len(source[start:end].encode())
        rows.append({"ordinal": k, "kind": kind, "value": value, "key_name": name, "span_start": a, "span_end": b})
    return {"literals": rows, "error": None}


def parse_script(source: Column) -> Column:
    """struct<literals, error> of a script."""

    @F.pandas_udf(RESULT)
    def read(sources: pd.Series) -> pd.DataFrame:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000))
        return pd.DataFrame([read_literals(s) for s in sources], columns=["literals", "error"])

    # else the optimizer puts a copy of the call under every filter on its result
    return read.asNondeterministic()(source)


def with_literals(scripts: DataFrame, source: str = "source") -> DataFrame:
    """The scripts with a column js: struct<literals, error>."""
    return scripts.withColumn("js", parse_script(F.col(source)))


def script_literals(parsed: DataFrame) -> DataFrame:
    """A row for each literal: the script's columns without js, and ordinal as literal, kind as literal_kind, value, key_name and span."""
    columns = [c for c in parsed.columns if c != "js"]
    rows = parsed.select(*columns, F.explode("js.literals").alias("l"))
    return rows.select(*columns, F.col("l.ordinal").alias("literal"), F.col("l.kind").alias("literal_kind"), "l.value", "l.key_name", "l.span_start", "l.span_end")


def script_errors(parsed: DataFrame) -> DataFrame:
    """The scripts that could not be read, with the error."""
    columns = [c for c in parsed.columns if c != "js"]
    return parsed.where("js.error is not null").select(*columns, F.col("js.error").alias("error"))
