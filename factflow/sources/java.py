"""Facts from Java source files: a tokenizer, a recursive-descent reader of declarations, and an evaluator of expressions.

Files are read with Spark's `binaryFile` source and parsed on executors, a file at a time, so a project is as parallel as
its files. Types are resolved within a file: imports first, then classes of the file, then java.lang, then the package.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_DIRS = ["target", "build", ".git", "node_modules"]
JAVA_LANG = set("Object String Integer Long Double Float Boolean Byte Short Character Number Class Thread Runnable Iterable Comparable Exception RuntimeException Error Throwable StringBuilder System Math Void Override Enum Record".split())
PRIMITIVES = set("int long double float boolean byte short char void".split())
MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
#: Statement words that an expression or a declaration does not begin with.
CONTROL = set("if else for while do switch case try catch finally throw break continue synchronized assert".split())

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[+\-*/%&|^]=|.)""",
    re.S,
)
FACTS = "file_path STRING, relation STRING, a STRING, b STRING, c STRING, d STRING, e STRING, f STRING"
#: Relations with the names of their columns.
RELATIONS = {
    "classes": ("fqn", "kind"), "class_hierarchy": ("class_fqn", "parent_fqn"), "method_declarations": ("method_fqn", "class_fqn", "method_name", "params"),
    "allocation_sites": ("alloc_id", "class_fqn", "method_fqn"), "source_assignments": ("lhs", "rhs", "assignment_type", "method_fqn"),
    "call_sites": ("call_id", "method_fqn", "receiver", "method_name", "lhs", "static_callee"), "call_arguments": ("call_id", "arg_index", "arg_var", "arg_type"),
    "class_annotations": ("class_fqn", "annotation_name"), "field_annotations": ("class_fqn", "field_name", "annotation_name"), "method_annotations": ("method_fqn", "annotation_name"),
    "parameter_annotations": ("method_fqn", "parameter_name", "annotation_name"), "variable_types": ("var", "type"), "errors": ("message",),
}


def tokens(code: str) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(code) if m.lastgroup != "skip"]


def _is_word(t: str) -> bool:
    return bool(t) and (t[0].isalpha() or t[0] in "_$")


class Reader:
    """Facts of one file."""

    def __init__(self, code: str):
        self.t, self.i, self.out = tokens(code), 0, []
        self.package, self.imports, self.known = "", {}, {}

    # --- tokens
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def next(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def take(self, t: str) -> bool:
        if self.peek() == t:
            self.i += 1
            return True
        return False

    def closed(self, a: str, b: str) -> list[str]:
        """Tokens between the opening token at hand and its closing one."""
        start, depth = self.i + 1, 0
        while self.i < len(self.t):
            t = self.next()
            depth += (t == a) - (t == b)
            if not depth:
                break
        return self.t[start : self.i - 1]

    def until(self, *ends: str) -> list[str]:
        start, depth = self.i, 0
        while self.i < len(self.t) and (depth or self.peek() not in ends):
            t = self.next()
            depth += (t in "([{") - (t in ")]}")
        return self.t[start : self.i]

    # --- names
    def dotted(self) -> str:
        parts = [self.next()]
        while self.peek() == "." and _is_word(self.peek(1)):
            self.i += 1
            parts.append(self.next())
        return ".".join(parts)

    def resolve(self, name: str) -> str:
        """Full name of a type as written: generics and arrays cut."""
        name = name.split("<")[0].replace("[", "").replace("]", "").replace("...", "").strip()
        if not name or name in PRIMITIVES or name == "var":
            return name or "java.lang.Object"
        head = name.split(".")[0]
        if name in self.imports:
            return self.imports[name]
        if name in self.known:
            return self.known[name]
        if head != name:
            return name if head[0].islower() else f"{self.resolve(head)}${name.split('.', 1)[1].replace('.', '$')}"
        if name in JAVA_LANG:
            return f"java.lang.{name}"
        return f"{self.package}.{name}" if self.package else name

    def type_name(self) -> str:
        name = self.dotted()
        if self.peek() == "<":
            depth = 0
            while self.i < len(self.t):
                t = self.next()
                depth += (t == "<") - (t == ">")
                if not depth:
                    break
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            name += "[]"
        while self.peek() == ".":
            self.i += 1
        return name

    def annotations(self) -> list[str]:
        out = []
        while self.peek() == "@" and self.peek(1) != "interface":
            self.i += 1
            name = self.dotted().split(".")[-1]
            out.append(name)
            if self.peek() == "(":
                args = self.closed("(", ")")
                if args:
                    text = "".join(args)
                    if not name.endswith("Mapping"):
                        while len(args) > 2 and args[1] == "=" and args[0] in ("value", "pointcut", "name"):
                            args = args[2:]
                        text = args[0][1:-1] if args[0][:1] == '"' else "".join(args)
                    out.append(f"{name}:{text}")
        return out

    def modifiers(self) -> list[str]:
        found = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                found += self.annotations()
            elif self.peek() in MODIFIERS:
                self.i += 1
            else:
                return found

    def put(self, relation: str, *row) -> None:
        self.out.append((relation, *row))

    # --- declarations
    def read(self) -> list[tuple]:
        if self.t and "package" in self.t[:400]:
            k = self.t.index("package")
            self.i = k + 1
            self.package = self.dotted()
            self.i = 0
        for k, t in enumerate(self.t):
            if t == "import" and self.t[k + 1 : k + 2] != ["static"]:
                self.i = k + 1
                name = self.dotted()
                if self.peek() != ".":
                    self.imports[name.split(".")[-1]] = name
            elif t in ("class", "interface", "enum", "record") and k + 1 < len(self.t) and _is_word(self.t[k + 1]) and self.t[k - 1 : k] != ["."]:
                self.known.setdefault(self.t[k + 1], f"{self.package}.{self.t[k + 1]}".lstrip("."))
        self.i = 0
        while self.i < len(self.t):
            marks = self.modifiers()
            if self.peek() in ("class", "interface", "enum", "record") and _is_word(self.peek(1)):
                self.type_declaration(marks, "")
            else:
                self.i += 1
        return self.out

    def type_declaration(self, marks: list[str], outer: str) -> None:
        kind, name = self.next(), self.next()
        fqn = f"{outer}${name}" if outer else f"{self.package}.{name}".lstrip(".")
        self.known[name] = fqn
        self.put("classes", fqn, "interface" if kind == "interface" else "class")
        for m in marks:
            self.put("class_annotations", fqn, m)
        while self.i < len(self.t) and self.peek() != "{":
            t = self.next()
            if t == "(":
                self.i -= 1
                self.closed("(", ")")
            elif t == "<":
                self.i -= 1
                depth = 0
                while self.i < len(self.t):
                    t = self.next()
                    depth += (t == "<") - (t == ">")
                    if not depth:
                        break
            elif t in ("extends", "implements"):
                self.put("class_hierarchy", fqn, self.resolve(self.type_name()))
                while self.take(","):
                    self.put("class_hierarchy", fqn, self.resolve(self.type_name()))
        body = self.closed("{", "}")
        self.members(body, fqn, name, kind)

    def members(self, body: list[str], fqn: str, simple: str, kind: str) -> None:
        saved, self.t, self.i = (self.t, self.i), body, 0
        fields, methods = {}, []
        if kind == "enum":
            self.until(";")
            self.take(";")
        while self.i < len(self.t):
            at = self.i
            if self.take(";"):
                continue
            marks = self.modifiers()
            if self.peek() in ("class", "interface", "enum", "record") and _is_word(self.peek(1)):
                self.type_declaration(marks, fqn)
                continue
            if self.peek() == "{":
                self.closed("{", "}")
                continue
            if self.peek() == "<":
                while self.i < len(self.t) and self.next() != ">":
                    pass
            if self.peek() == simple and self.peek(1) == "(":
                type_, name = "void", "<init>"
                self.i += 1
            else:
                type_ = self.type_name() if _is_word(self.peek()) else ""
                name = self.next()
            if self.peek() == "(":
                params = self.parameters(self.closed("(", ")"))
                self.until("{", ";")
                method_body = self.closed("{", "}") if self.peek() == "{" else (self.next() and None)
                methods.append((name, params, marks, method_body))
            elif _is_word(name):
                fields[name] = type_
                for m in [*marks, f"FieldType:{self.resolve(type_)}"]:
                    self.put("field_annotations", fqn, name, m)
                self.until(";")
                self.take(";")
            if self.i == at:
                self.i += 1
        for name, params, marks, method_body in methods:
            m = f"{fqn}.{name}({','.join(self.resolve(p[0]) for p in params)})"
            self.put("method_declarations", m, fqn, name, ",".join(p[1] for p in params))
            for a in marks:
                self.put("method_annotations", m, a)
            for type_p, pname, pmarks in params:
                for a in [*pmarks, f"FieldType:{self.resolve(type_p)}"]:
                    self.put("parameter_annotations", m, pname, a)
                self.put("variable_types", f"{m}#{pname}", self.resolve(type_p))
            for k, (_, pname, _) in enumerate(params):
                self.put("source_assignments", f"{m}#{pname}", f"{m}#p{k}", "COPY", m)
            if method_body is not None:
                Body(self, m, fqn, {p[1]: p[0] for p in params}, fields, method_body).run()
        self.t, self.i = saved

    def parameters(self, t: list[str]) -> list[tuple[str, str, list[str]]]:
        saved, self.t, self.i, out = (self.t, self.i), t, 0, []
        while self.i < len(self.t):
            marks = self.modifiers()
            type_ = self.type_name()
            while self.peek() == ".":
                self.i += 1
            out.append((type_, self.next(), marks))
            self.until(",")
            self.take(",")
        self.t, self.i = saved
        return out


class Body:
    """Statements of one method, with a variable for each value that flows."""

    def __init__(self, reader: Reader, method: str, cls: str, params: dict, fields: dict, t: list[str]):
        self.r, self.m, self.cls, self.locals, self.fields, self.t = reader, method, cls, dict(params), fields, t
        self.n = self.calls = self.allocs = 0

    def temp(self, kind: str) -> str:
        self.n += 1
        return f"{self.m}#temp_{kind}_{self.n}"

    def assign(self, lhs: str, rhs: str, kind: str) -> None:
        self.r.put("source_assignments", lhs, rhs, kind, self.m)

    def run(self) -> None:
        at = 0
        for k, t in enumerate(self.t):
            if t in (";", "{", "}") and self._depth(at, k) == 0:
                self.statement(self.t[at:k])
                at = k + 1
        self.statement(self.t[at:])

    def _depth(self, a: int, b: int) -> int:
        part = self.t[a:b]
        return part.count("(") - part.count(")")

    def statement(self, s: list[str]) -> None:
        while s and s[0] in CONTROL:
            if s[0] in ("if", "while", "switch", "for", "catch", "synchronized", "try") and s[1:2] == ["("]:
                end = self._close(s, 1)
                inner = s[2:end]
                for part in self._split(inner, ";"):
                    if s[0] != "catch":
                        self.statement(self._foreach(part))
                s = s[end + 1 :]
            elif s[0] == "case":
                return
            else:
                s = s[1:]
        if not s:
            return
        if s[0] == "return":
            v = self.value(s[1:])[0]
            if v:
                self.assign(f"{self.m}#return", v, "COPY")
            return
        eq = self._top(s, "=")
        left, right = (s[:eq], s[eq + 1 :]) if eq >= 0 else (s, [])
        words = [t for t in left if t != "final"]
        if len(words) >= 2 and _is_word(words[-1]) and _is_word(words[0]) and words[-2] != "." and not {"(", '"'} & set(words):
            type_ = "".join(words[:-1])
            self.locals[words[-1]] = type_
            if type_ != "var":
                self.r.put("variable_types", f"{self.m}#{words[-1]}", self.r.resolve(type_))
            left = [words[-1]]
        elif eq < 0:
            self.value(s, drop=True)
            return
        if eq < 0:
            return
        v, type_ = self.value(right)
        if not v:
            return
        if self.locals.get(left[0]) == "var" and len(left) == 1:
            self.locals[left[0]] = type_
        if len(left) == 1 and left[0] in self.locals:
            self.assign(f"{self.m}#{left[0]}", v, "COPY")
        elif left[0] == "this" and len(left) == 3:
            self.assign(f"{self.m}#this.{left[2]}", v, "FIELD_WRITE")
        elif len(left) == 1 and _is_word(left[0]):
            self.assign(f"{self.m}#this.{left[0]}" if left[0] in self.fields else f"{self.m}#{left[0]}", v, "FIELD_WRITE" if left[0] in self.fields else "COPY")
        elif len(left) >= 3 and left[-2] == "." and _is_word(left[-1]):
            base = self.value(left[:-2])[0]
            if base:
                self.assign(f"{base}.{left[-1]}", v, "FIELD_WRITE")

    def _foreach(self, part: list[str]) -> list[str]:
        k = self._top(part, ":")
        return [*part[:k], "=", *part[k + 1 :]] if k > 0 and "?" not in part else part

    @staticmethod
    def _close(s: list[str], at: int) -> int:
        depth = 0
        for k in range(at, len(s)):
            depth += (s[k] in "([{") - (s[k] in ")]}")
            if not depth:
                return k
        return len(s) - 1

    def _top(self, s: list[str], op: str) -> int:
        depth = 0
        for k, t in enumerate(s):
            depth += (t in "([{") - (t in ")]}")
            if not depth and t == op:
                return k
        return -1

    def _split(self, s: list[str], op: str) -> list[list[str]]:
        out = []
        while (k := self._top(s, op)) >= 0:
            out.append(s[:k])
            s = s[k + 1 :]
        return [*out, s] if s or out else []

    def _alloc(self, alloc_id: str, cls: str, temp: str) -> tuple[str, str]:
        self.r.put("allocation_sites", alloc_id, cls, self.m)
        v = self.temp(temp)
        self.assign(v, alloc_id, "ALLOC")
        return v, cls

    def value(self, s: list[str], drop: bool = False) -> tuple[str | None, str]:
        """Variable and type of an expression; operators are evaluated for the calls within and give no variable."""
        if not s:
            return None, "java.lang.Object"
        if s[0] == "(" and self._close(s, 0) < len(s) - 1 and s[self._close(s, 0) + 1] not in (".", "?", "+", "-", "*", "/", "==", "!=", "&&", "||", "->", "<", ">", "%"):
            cast = "".join(s[1 : self._close(s, 0)])
            return self.value(s[self._close(s, 0) + 1 :])[0], self.r.resolve(cast)
        if self._top(s, "->") >= 0:
            return None, "java.lang.Object"
        if (k := self._top(s, "?")) >= 0:
            self.value(s[:k])
            arms = [self.value(a) for a in self._split(s[k + 1 :], ":")]
            v = self.temp("cond")
            for a, _ in arms:
                if a:
                    self.assign(v, a, "COPY")
            return v, arms[0][1] if arms else "java.lang.Object"
        for op in ("||", "&&", "==", "!=", "<=", ">=", "+", "-", "*", "/", "%", "instanceof", "!"):
            if self._top(s, op) >= 0 and "new" not in s[:1]:
                for part in self._split(s, op):
                    self.value(part)
                return None, "java.lang.Object"
        v, type_, k = self._primary(s)
        while k < len(s) and s[k] == ".":
            name = s[k + 1] if k + 1 < len(s) else ""
            if s[k + 2 : k + 3] == ["("]:
                end = self._close(s, k + 2)
                v, type_ = self._call(v, type_, name, s[k + 3 : end], drop and end == len(s) - 1)
                k = end + 1
            elif name == "class":
                return self._alloc(f"ReflectClassAlloc:{type_}", "java.lang.Class", "class_alloc")
            else:
                if v:
                    t = self.temp("field")
                    self.assign(t, f"{v}.{name}", "FIELD_READ")
                    v = t
                k += 2
        return v, type_

    def _primary(self, s: list[str]) -> tuple[str | None, str, int]:
        t = s[0]
        if t == "(":
            end = self._close(s, 0)
            return *self.value(s[1:end]), end + 1
        if t == "new":
            k = 1
            while k < len(s) and s[k] not in ("(", "[", "{"):
                k += 1
            cls = self.r.resolve("".join(s[1:k]))
            self.allocs += 1
            v, _ = self._alloc(f"{self.m}:alloc_{self.allocs}", cls, "alloc")
            if s[k : k + 1] != ["("]:
                return v, cls, len(s)
            end = self._close(s, k)
            args = [self.value(a) for a in self._split(s[k + 1 : end], ",")]
            self._site(v, cls, "<init>", args, None)
            nxt = end + 1
            return v, cls, self._close(s, nxt) + 1 if s[nxt : nxt + 1] == ["{"] else nxt
        if t[:1] == '"':
            return *self._alloc(f"StringAlloc:{t[1:-1]}", "java.lang.String", "str_alloc"), 1
        if t == "this":
            return f"{self.m}#this", self.cls, 1
        if _is_word(t):
            if s[1:2] == ["("]:
                end = self._close(s, 1)
                return *self._call(f"{self.m}#this", self.cls, t, s[2:end], False), end + 1
            if t in self.locals:
                return f"{self.m}#{t}", self.r.resolve(self.locals[t]), 1
            if t in self.fields:
                v = self.temp("field")
                self.assign(v, f"{self.m}#this.{t}", "FIELD_READ")
                return v, self.r.resolve(self.fields[t]), 1
            return None, self.r.resolve(t), 1
        return None, "java.lang.Object", 1

    def _call(self, receiver: str | None, type_: str, name: str, args: list[str], drop: bool) -> tuple[str, str]:
        given = [self.value(a) for a in self._split(args, ",")]
        lhs = self.temp("void_call" if drop else "call_lhs")
        self._site(receiver, type_, name, given, lhs)
        return lhs, "java.lang.Object"

    def _site(self, receiver, type_, name, args, lhs) -> None:
        self.calls += 1
        call = f"{self.m}:call_{self.calls}"
        self.r.put("call_sites", call, self.m, receiver, name, lhs, f"{type_}.{name}({','.join(t for _, t in args)})")
        for k, (v, t) in enumerate(args):
            if v:
                self.r.put("call_arguments", call, str(k), v, t)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                found = Reader((content or b"").decode("utf-8", "replace")).read()
            except (IndexError, ValueError, RecursionError) as e:
                found = [("errors", repr(e))]
            rows += [(path, *r, *[None] * (7 - len(r))) for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(8)], names=["file_path", "relation", *"abcdef"])


def java_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the .java files under a folder, build and tool folders left out."""
    skipped = "|".join(map(re.escape, SKIPPED_DIRS))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(path).where(~F.col("path").rlike(f"/(?:{skipped})/"))


def facts(files: DataFrame) -> DataFrame:
    """All facts of `files` (path, content) as one tagged table. Files that cannot be read give a row in `errors`."""
    return files.select("path", "content").mapInArrow(_parsed, FACTS)


def relation(tagged: DataFrame, name: str) -> DataFrame:
    """One fact table with its own column names, rows once each."""
    out = tagged.where(F.col("relation") == name).select(*[F.col(c).alias(n) for c, n in zip("abcdef", RELATIONS[name], strict=False)]).distinct()
    return out.withColumn("arg_index", F.col("arg_index").cast("int")) if name == "call_arguments" else out


def provenance(tagged: DataFrame) -> DataFrame:
    return tagged.where("relation = 'classes'").select("file_path", F.col("a").alias("class_fqn")).distinct()
