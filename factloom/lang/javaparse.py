"""Declarations, calls and field accesses of a Java file, in one tolerant pass.

Bodies are read as chains: a first operand and what is selected from or called on
it. Walking a chain carries its context (which form and entry a data object
belongs to), so accesses are recorded with what is known of their source; what
is not known stays open and is settled later by joins over all files.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from factloom.lang.lexer import NAME, STRING, Token, tokens

# Words of the Java language.
TYPE_WORDS = frozenset("class interface enum record".split())
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
NOT_CALLS = frozenset("if for while switch catch return synchronized try throw assert else do new super this instanceof case yield".split())
PRIMITIVES = frozenset("int long short byte char boolean float double void var".split())
# The platform's API that reads and writes form data.
MODEL_GETTERS = frozenset(["getModel"])
OBJECT_READS = frozenset(
    "get getString getInt getLong getBigDecimal getBoolean getDate getDynamicObject getDynamicObjectCollection getLocaleString".split()
)
LOADERS = frozenset("load loadSingle loadSingleFromCache loadFromCache loadHead newDynamicObject loadReferenceObject query queryOne".split())
LOADER_CLASSES = frozenset("BusinessDataServiceHelper BusinessDataReader QueryServiceHelper".split())
FORM_ARGUMENT = {"loadSingle": (1, 0), "loadSingleFromCache": (1, 0), "load": (0, 1), "loadFromCache": (0, 1)}
COLLECTION_STEPS = frozenset("stream filter sorted distinct parallelStream toList iterator collect subList".split())
ELEMENT_STEPS = frozenset("get next addNew findFirst findAny orElse orElseGet remove".split())
SINKS = {
    "SaveServiceHelper": frozenset("save update saveOperate".split()),
    "OperationServiceHelper": frozenset(["executeOperate"]),
    "BusinessDataServiceHelper": frozenset(["save"]),
    "DeleteServiceHelper": frozenset(["delete"]),
    "DB": frozenset("execute update executeBatch insert".split()),
}
PERSISTING_INVOKES = frozenset("save submit audit unaudit unsubmit delete push".split())

MOST_SPANS = 50
#: Begins the form of a context that names a constant instead of a form.
CONSTANT_FORM = "const:"


@dataclass(slots=True)
class Context:
    """What a value stands for: a model, a data object or a collection of them, of the
    plugin's own form (``own``), of a named form, or of a parameter's."""

    kind: str
    source: str
    form: str | None = None
    level: str = "header"
    entry: str | None = None
    param: int | None = None

    def step(self, **changes) -> Context:
        return Context(**{**asdict(self), **changes})


@dataclass
class Parsed:
    package: str = ""
    status: str = "ok"
    errors: int = 0
    spans: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    constants: list[dict] = field(default_factory=list)
    accesses: list[dict] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)


def key_of(part: list[Token], strings: dict[str, str | None], loops: set[str]) -> dict:
    """How a key argument resolves: literal, a constant to look up, or why it does not."""
    out = {"key": None, "key_class": None, "key_const": None, "key_resolution": "unknown"}
    if len(part) == 1 and part[0].kind == STRING:
        return out | {"key": part[0].text, "key_resolution": "literal"}
    if any(t.text == "+" for t in part):
        return out | {"key_resolution": "concat"}
    names = [t.text for t in part[::2]]
    if part and len(part) % 2 and all(t.kind == NAME for t in part[::2]) and all(t.text == "." for t in part[1::2]):
        last = names[-1]
        if len(names) == 1 and last in strings:
            return out | ({"key": strings[last], "key_resolution": "literal"} if strings[last] is not None else {"key_resolution": "concat"})
        if len(names) == 1 and last in loops:
            return out | {"key_resolution": "dynamic-loop"}
        if re.fullmatch(r"[A-Z][A-Z0-9_]*", last):
            return out | {"key_class": names[-2] if len(names) > 1 else None, "key_const": last, "key_resolution": "constant"}
        return out
    return out | {"key_resolution": "dynamic"}


class Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.t = tokens(source)
        self.out = Parsed()
        #: What methods of each class return, where all their returns agree.
        self.returns: dict[tuple[str, str], Context | None] = {}
        self.match = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Partner of each bracket; unbalanced ones are errors."""
        pairs, stack, close = {}, [], {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.t):
            if t.kind == "operator" and t.text in "([{":
                stack.append(i)
            elif t.kind == "operator" and t.text in ")]}":
                while stack and self.t[stack[-1]].text != close[t.text] and any(self.t[k].text == close[t.text] for k in stack):
                    self._error(stack.pop())
                if stack and self.t[stack[-1]].text == close[t.text]:
                    pairs[i] = stack[-1]
                    pairs[stack.pop()] = i
                else:
                    self._error(i)
        for i in stack:
            self._error(i)
        return pairs

    def _error(self, i: int) -> None:
        self.out.errors += 1
        self.out.status = "partial"
        if len(self.out.spans) < MOST_SPANS:
            self.out.spans.append({"line": self.t[i].line, "text": self.t[i].text})

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == NAME

    def end(self, i: int) -> int:
        """Partner of an opening bracket, or the last token."""
        return self.match.get(i, len(self.t) - 1)

    def source_of(self, lo: int, hi: int) -> str:
        """Source text of tokens lo to hi - 1."""
        if lo >= hi:
            return ""
        last = self.t[hi - 1]
        size = len(last.text) + (2 if last.kind == STRING else 0)
        return self.source[self.t[lo].at : last.at + size]

    # declarations

    def read(self) -> Parsed:
        i = 0
        while i < len(self.t):
            if self.text(i) == "package" and not self.out.package:
                stop = next((k for k in range(i, len(self.t)) if self.text(k) == ";"), len(self.t))
                self.out.package = "".join(x.text for x in self.t[i + 1 : stop])
                i = stop + 1
            elif self.text(i) == "import":
                i = next((k for k in range(i, len(self.t)) if self.text(k) == ";"), len(self.t)) + 1
            else:
                i = self.member(i, len(self.t), None)
        return self.out

    def annotation(self, i: int) -> tuple[int, dict]:
        """After '@': the annotation's name and its string or constant value."""
        name, k = self.text(i + 1), i + 2
        while self.text(k) == "." and self.is_name(k + 1):
            name, k = self.text(k + 1), k + 2
        found = {"name": name, "values": []}
        if self.text(k) == "(":
            stop = self.end(k)
            found["values"] = [x.text for x in self.t[k + 1 : stop] if x.kind == STRING]
            k = stop + 1
        return k, found

    def member(self, i: int, stop: int, owner: dict | None) -> int:
        """Read one declaration; returns where the next begins."""
        start, marks, words = i, [], []
        while i < stop and (self.text(i) in MODIFIERS or self.text(i) == "@" and self.text(i + 1) != "interface" or self.text(i) == "non"):
            if self.text(i) == "@":
                i, mark = self.annotation(i)
                marks.append(mark)
            else:
                words.append(self.text(i))
                i += 1
        if i >= stop:
            return stop
        if self.text(i) == "@" or self.text(i) in TYPE_WORDS and self.is_name(i + 1):
            return self.type_declaration(i + (self.text(i) == "@"), stop, owner, marks)
        if owner is None or self.text(i) in ";}":
            return i + 1
        if self.text(i) == "{":
            self.body("<clinit>" if "static" in words else "<initializer>", owner, [], i, self.end(i))
            return self.end(i) + 1
        if self.text(i) == "<":
            i = self.generics(i)
        if self.text(i) == owner["simple"] and self.text(i + 1) == "(":
            return self.method(i, i, owner, "<init>", marks)
        head = i
        while i < stop and self.text(i) not in ("(", "=", ";", "{", "}", ",") or self.text(i) == "," and False:
            i = self.generics(i) if self.text(i) == "<" else self.annotation(i)[0] if self.text(i) == "@" else i + 1
        if self.text(i) == "(" and self.is_name(i - 1) and i - 1 > head:
            return self.method(head, i - 1, owner, self.text(i - 1), marks)
        if self.text(i) in ("=", ";", ",") and self.is_name(i - 1) and i - 1 > head:
            return self.fields(head, i - 1, stop, owner, marks, words)
        if owner["kind"] == "enum" and self.is_name(head):
            k = head + 1
            if self.text(k) == "(":
                self.walk_in("<clinit>", owner, k + 1, self.end(k))
                k = self.end(k) + 1
            return (self.end(k) + 1 if self.text(k) == "{" else k) + (self.text(k) in ",;")
        return max(i, start) + 1

    def generics(self, i: int) -> int:
        """After the '<' at i: past its matching '>'."""
        depth = 0
        for k in range(i, len(self.t)):
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            if depth <= 0:
                return k + 1
            if self.text(k) in ("{", ";", "(", ")"):
                return k
        return len(self.t)

    def type_declaration(self, i: int, stop: int, owner: dict | None, marks: list[dict]) -> int:
        kind, simple = self.text(i), self.text(i + 1)
        name = f"{owner['fqn']}${simple}" if owner else f"{self.out.package}.{simple}".lstrip(".")
        supers, k, listing = [], i + 2, False
        while k < stop and self.text(k) != "{":
            if self.text(k) == "<":
                k = self.generics(k)
                continue
            if self.text(k) == "(":
                k = self.end(k) + 1
                continue
            if self.text(k) in ("extends", "implements"):
                listing = True
            elif self.text(k) == "permits":
                listing = False
            elif listing and self.is_name(k) and self.text(k + 1) != ".":
                supers.append(self.text(k))
            k += 1
        close = self.end(k) if k < stop else stop - 1
        decl = {
            "fqn": name, "simple": simple, "kind": kind, "supers": supers, "line": self.t[i].line,
            "end_line": self.t[min(close, len(self.t) - 1)].line, "fields": {},
        }
        self.out.types.append({x: decl[x] for x in ("fqn", "simple", "kind", "supers", "line", "end_line")})
        self._annotate(name, None, marks)
        self._member_types(k + 1, close, decl)
        at = k + 1
        while at < close:
            at = max(at + 1, self.member(at, close, decl))
        return close + 1

    def _member_types(self, lo: int, hi: int, decl: dict) -> None:
        """Types of fields, ahead of the bodies that use them."""
        k = lo
        while k < hi:
            if self.text(k) in "{(" and self.match.get(k):
                k = self.end(k) + 1
                continue
            if self.is_name(k) and self.text(k + 1) in ("=", ";") and k > lo and (self.is_name(k - 1) or self.text(k - 1) in (">", "]")):
                back = k - 1
                while back > lo and self.text(back) not in (";", "}", "{", ")"):
                    back -= 1
                names = [x.text for x in self.t[back + 1 : k] if x.kind == NAME and x.text not in MODIFIERS]
                if names:
                    decl["fields"][self.text(k)] = names[0]
            k += 1

    def _annotate(self, cls: str, member: str | None, marks: list[dict]) -> None:
        for mark in marks:
            for value in mark["values"] or [None]:
                self.out.annotations.append({"class_fqn": cls, "member": member, "name": mark["name"], "value": value})

    def fields(self, head: int, name: int, stop: int, owner: dict, marks: list[dict], words: list[str]) -> int:
        self._annotate(owner["fqn"], self.text(name), marks)
        k = name
        while k < stop and self.text(k) != ";":
            if self.is_name(k) and self.text(k + 1) == "=":
                value = k + 2
                if value < len(self.t) and self.t[value].kind == STRING and self.text(value + 1) in (";", ",") and ("final" in words or owner["kind"] == "interface"):
                    self.out.constants.append(
                        {"class_name": owner["simple"], "const_name": self.text(k), "literal": self.text(value), "line": self.t[k].line}
                    )
                depth_end = value
                while depth_end < stop and self.text(depth_end) not in (";", ","):
                    depth_end = self.end(depth_end) + 1 if self.text(depth_end) in ("(", "{", "[") else depth_end + 1
                self.walk_in("<clinit>" if "static" in words else "<field-init>", owner, value, depth_end)
                k = depth_end
            else:
                k = self.generics(k) if self.text(k) == "<" else k + 1
        return k + 1

    def method(self, head: int, name: int, owner: dict, called: str, marks: list[dict]) -> int:
        open_ = name + 1
        close = self.end(open_)
        params, k = [], open_ + 1
        while k < close:
            part_end = k
            while part_end < close and self.text(part_end) != ",":
                part_end = self.generics(part_end) if self.text(part_end) == "<" else self.end(part_end) + 1 if self.text(part_end) == "(" else part_end + 1
            names = [x.text for x in self.t[k:part_end] if x.kind == NAME and x.text not in MODIFIERS]
            if len(names) >= 2:
                params.append({"type": names[0], "name": names[-1]})
            k = part_end + 1
        k = close + 1
        while k < len(self.t) and self.text(k) not in ("{", ";", "}"):
            k += 1
        stop = self.end(k) if self.text(k) == "{" else k
        overload = sum(m["class_fqn"] == owner["fqn"] and m["name"] == called for m in self.out.methods)
        self.out.methods.append(
            {
                "class_fqn": owner["fqn"], "name": called, "overload": overload, "params": params,
                "line": self.t[name].line, "end_line": self.t[min(stop, len(self.t) - 1)].line, "sink": False,
            }
        )
        self._annotate(owner["fqn"], called, marks)
        if self.text(k) == "{":
            self.body(called, owner, params, k, stop)
        return stop + 1

    # bodies

    def body(self, method: str, owner: dict, params: list[dict], lo: int, hi: int) -> None:
        scope = Body(self, method, owner, params)
        scope.walk(lo + 1, hi)
        if scope.late:  # a loop may use what is only known after it: read once more
            again = Body(self, method, owner, params, scope.contexts)
            again.silent = True
            again.walk(lo + 1, hi)
            scope.merge(again)
        self.out.calls += scope.calls
        self.out.accesses += scope.accesses
        if scope.returned:
            key, found = (owner["fqn"], method), scope.returned[0]
            agreed = all(c == found for c in scope.returned) and self.returns.get(key, found) == found
            self.returns[key] = found if agreed else None
        for m in reversed(self.out.methods):
            if m["class_fqn"] == owner["fqn"] and m["name"] == method:
                m["sink"] = scope.sink
                break

    def walk_in(self, method: str, owner: dict, lo: int, hi: int) -> None:
        scope = Body(self, method, owner, [])
        scope.walk(lo, hi)
        self.out.calls += scope.calls
        self.out.accesses += scope.accesses


class Body:
    """One method: variables in order of the text, calls and accesses."""

    def __init__(self, reader: Reader, method: str, owner: dict, params: list[dict], known: dict[str, Context] | None = None) -> None:
        self.r, self.method, self.owner = reader, method, owner
        self.types = {**owner["fields"], **{p["name"]: p["type"] for p in params}}
        self.contexts: dict[str, Context] = dict(known or {})
        self.strings: dict[str, str | None] = {}
        self.loops: set[str] = set()
        self.calls: list[dict] = []
        self.accesses: list[dict] = []
        self.late = self.silent = self.sink = False
        self.operand: str | None = None
        self.returned: list[Context | None] = []
        for i, p in enumerate(params):
            if p["type"] in ("DynamicObject", "DynamicObjectCollection", "List", "Collection"):
                self.contexts[p["name"]] = Context("object" if p["type"] == "DynamicObject" else "collection", "param", param=i)
            elif p["type"] in ("IDataModel", "IBillModel"):
                self.contexts[p["name"]] = Context("model", "own")
            elif p["type"].endswith(("Args", "Event", "EventArgs")):
                self.contexts[p["name"]] = Context("event", "own")

    def merge(self, again: Body) -> None:
        better = {(a["line"], a["col"]): a for a in again.accesses}
        for a in self.accesses:
            if a["source"] is None and (b := better.get((a["line"], a["col"]))) and b["source"]:
                a.update({k: b[k] for k in ("source", "form", "level", "entry", "param")})

    def walk(self, lo: int, hi: int) -> None:
        r, i = self.r, lo
        while i < hi:
            t = r.t[i]
            if t.kind == NAME and t.text == "for" and r.text(i + 1) == "(":
                i = self.loop(i + 1)
                continue
            if t.kind == NAME and t.text == "return" and r.text(i + 1) not in (";", "null"):
                found = self.value(i + 1, hi)
                self.returned.append(found if found and found.source in ("own", "form", "dynamic") else None)
            if t.kind == NAME and t.text not in NOT_CALLS and r.text(i - 1) != ".":
                declared = self.declaration(i, hi)
                if declared:
                    i = declared
                    continue
            if r.text(i) == "=" and r.is_name(i - 1) and r.text(i - 2) != ".":
                _, i = self.assign(r.text(i - 1), i + 1, hi)
                continue
            if self.starts_chain(i):
                _, i = self.chain(i, hi)
                continue
            i += 1

    def starts_chain(self, i: int) -> bool:
        t = self.r.t[i]
        if t.kind == STRING:
            return True
        return t.kind == NAME and self.r.text(i - 1) not in (".", "::") and (t.text in ("this", "super", "new") or t.text not in NOT_CALLS)

    def declaration(self, i: int, hi: int) -> int | None:
        """Type name [= value]: remember the variable; returns where to go on."""
        r, k = self.r, i + 1
        while r.text(k) == "." and r.is_name(k + 1):
            k += 2
        if r.text(k) == "<":
            k = r.generics(k)
        while r.text(k) == "[" and r.text(k + 1) == "]":
            k += 2
        if not r.is_name(k) or r.text(k) in NOT_CALLS or r.text(k) == "instanceof" or r.text(k + 1) not in ("=", ";", ":", ",", ")"):
            return None
        if not (r.text(i)[:1].isupper() or r.text(i) in PRIMITIVES or r.text(i + 1) == "."):
            return None
        self.types[r.text(k)] = r.text(i)
        return k + 1

    def assign(self, name: str, i: int, hi: int) -> tuple[Context | None, int]:
        r = self.r
        if i < len(r.t) and r.t[i].kind == STRING and r.text(i + 1) == ";":
            self.strings[name] = r.text(i)
            return None, i + 1
        stop = i
        while stop < hi and r.text(stop) not in (";", ","):
            stop = r.end(stop) + 1 if r.text(stop) in ("(", "{", "[") else stop + 1
        if any(x.text == "+" for x in r.t[i:stop]) and any(x.kind == STRING for x in r.t[i:stop]):
            self.strings[name] = None
        found = self.value(i, hi)
        if found:
            self.contexts[name] = found
        elif name in self.contexts and self.contexts[name].source != "own":
            self.contexts.pop(name)
        return found, i

    def value(self, i: int, hi: int) -> Context | None:
        """Context of the expression at i, without recording anything."""
        r = self.r
        while r.text(i) == "(" and r.end(i) < hi and (r.is_name(r.end(i) + 1) or r.text(r.end(i) + 1) == "("):
            i = r.end(i) + 1
        if i >= hi or not self.starts_chain(i):
            return None
        calls, accesses, sink = len(self.calls), len(self.accesses), self.sink
        found, _ = self.chain(i, hi)
        del self.calls[calls:], self.accesses[accesses:]
        self.sink = sink
        return found

    def loop(self, open_: int) -> int:
        r, close = self.r, self.r.end(open_)
        colon = next((k for k in range(open_, close) if r.text(k) == ":" and r.is_name(k - 1)), None)
        if colon is None:
            return open_ + 1
        name, over = r.text(colon - 1), self.value(colon + 1, close)
        self.loops.add(name)
        kind = next((x.text for x in r.t[open_ + 1 : colon - 1] if x.kind == NAME and x.text not in MODIFIERS), "")
        self.types[name] = kind
        if over and over.kind in ("collection", "array"):
            self.contexts[name] = over.step(kind="object")
        elif kind == "DynamicObject":
            self.late = True
        return colon + 1

    def arguments(self, open_: int) -> list[tuple[int, int]]:
        r, close = self.r, self.r.end(open_)
        parts, lo, k = [], open_ + 1, open_ + 1
        while k < close:
            if r.text(k) in ("(", "{", "["):
                k = r.end(k) + 1
                continue
            if r.text(k) == ",":
                parts.append((lo, k))
                lo = k + 1
            k += 1
        if lo < close:
            parts.append((lo, close))
        return parts

    def chain(self, i: int, hi: int) -> tuple[Context | None, int]:
        """Read a chain from i on; returns its context and where it ends."""
        r, start = self.r, i
        here: Context | None = None
        kind_name: str | None = None  # simple type of the operand, where known
        if r.text(i) == "new":
            k = i + 1
            while r.is_name(k) and r.text(k + 1) == ".":
                k += 2
            kind_name = r.text(k)
            k = r.generics(k + 1) if r.text(k + 1) == "<" else k + 1
            if r.text(k) == "(":
                args = self.arguments(k)
                self.record("<init>", "constructor", i, kind_name, kind_name, args)
                if kind_name == "DynamicObject" and args:
                    here = self.value(args[0][0], args[0][1])
                    here = here.step(kind="object") if here else None
                self.inside(args)
                k = r.end(k) + 1
            i = k
        elif r.t[i].kind == STRING:
            i += 1
        else:
            name = r.text(i)
            if r.text(i + 1) == "(":
                args = self.arguments(i + 1)
                here = self.called(name, i, start, None, None, args)
                self.inside(args)
                i = r.end(i + 1) + 1
            elif r.text(i + 1) == "->":
                return None, i + 2
            else:
                here, kind_name = self.contexts.get(name), self.types.get(name) or (name if name[:1].isupper() else None)
                if name in ("this", "super"):
                    kind_name = self.owner["simple"] if name == "this" else None
                i += 1
        while i < hi:
            if r.text(i) == "[" and i in r.match:
                self.walk(i + 1, r.end(i))
                here = here.step(kind="object") if here and here.kind in ("array", "collection") else here
                i = r.end(i) + 1
            elif r.text(i) == "::" and (r.is_name(i + 1)):
                called = "<init>" if r.text(i + 1) == "new" else r.text(i + 1)
                self.record(called, "method_reference", i + 1, r.source_of(start, i), kind_name, [])
                return None, i + 2
            elif r.text(i) == "." and r.text(i + 1) == "<":
                i = r.generics(i + 1) - 1
            elif r.text(i) == "." and r.is_name(i + 1):
                name = r.text(i + 1)
                if r.text(i + 2) == "(":
                    args = self.arguments(i + 2)
                    here = self.called(name, i + 1, start, here, kind_name, args)
                    if name == "forEach" and args and here is None:
                        pass
                    self.inside(args)
                    i, kind_name = r.end(i + 2) + 1, None
                else:
                    kind_name = self.types.get(name) if r.text(start) == "this" and i == start + 1 else (name if name[:1].isupper() else None)
                    here = self.contexts.get(name) if r.text(start) == "this" and i == start + 1 else None
                    i += 2
            else:
                break
        return here, i

    def inside(self, args: list[tuple[int, int]]) -> None:
        for lo, hi in args:
            self.walk(lo, hi)

    def record(self, name: str, kind: str, at: int, receiver: str, receiver_type: str | None, args: list[tuple[int, int]]) -> None:
        r = self.r
        sources = []
        for lo, hi in args:
            c = self.contexts.get(r.text(lo)) if hi - lo == 1 else self.value(lo, hi) if hi - lo > 1 else None
            sources.append({"source": c.source if c else None, "form": c.form if c else None, "param": c.param if c else None})
        self.calls.append(
            {
                "class_fqn": self.owner["fqn"], "method": self.method, "name": name, "kind": kind, "receiver": receiver,
                "receiver_type": receiver_type, "args": [r.source_of(lo, hi) for lo, hi in args], "sources": sources,
                "line": r.t[at].line, "col": r.t[at].col,
            }
        )

    def called(self, name: str, at: int, start: int, here: Context | None, kind_name: str | None, args: list[tuple[int, int]]) -> Context | None:
        """Record a call on ``here``; returns the context of its result."""
        r = self.r
        self.operand = r.text(start) if r.is_name(start) and r.text(start + 1) == "." else None
        receiver = r.source_of(start, at - 1) if at > start else ""
        self.record(name, "invocation", at, receiver, kind_name, args)
        tail = receiver.rsplit(".", 1)[-1].split("(", 1)[0]
        first = [r.t[k] for k in range(*args[0])] if args else []
        if name in SINKS.get(tail, ()) or name.startswith("invokeOperation") and len(first) == 1 and first[0].text in PERSISTING_INVOKES:
            self.sink = True
        if name in MODEL_GETTERS and not args:
            return Context("model", "own")
        if name in ("getDataEntity",) and (here is None or here.kind == "model"):
            return Context("object", "own")
        if name in ("getDataEntities", "getSelectedRows") and (here is None or here.kind == "event"):
            return Context("array", "own")
        if tail in LOADER_CLASSES and name in LOADERS:
            keys = [key_of([r.t[k] for k in range(*args[n])], self.strings, self.loops) for n in FORM_ARGUMENT.get(name, (0,)) if n < len(args)]
            form = next((k["key"] for k in keys if k["key_resolution"] == "literal"), None)
            named = next((k for k in keys if k["key_resolution"] == "constant"), None)
            if form is None and named:
                # to be looked up over all files
                form = f"{CONSTANT_FORM}{named['key_class'] or self.owner['simple']}.{named['key_const']}"
            one = name.startswith(("loadSingle", "newDynamic", "queryOne"))
            return Context("object" if one else "collection", "form" if form else "dynamic", form=form)
        if here is None:
            return r.returns.get((self.owner["fqn"], name)) if receiver in ("", "this") else None
        if here.kind == "model":
            return self.model_call(name, at, here, args)
        if here.kind == "object":
            return self.object_call(name, at, here, args)
        if here.kind in ("collection", "array"):
            if name in ELEMENT_STEPS:
                return here.step(kind="object")
            if name == "forEach" and args and r.text(args[0][0] + 1) == "->":
                self.contexts[r.text(args[0][0])] = here.step(kind="object")
            elif args and r.text(args[0][0] + 1) == "->" and name in ("filter", "map", "anyMatch", "allMatch", "noneMatch", "mapToInt", "peek"):
                self.contexts[r.text(args[0][0])] = here.step(kind="object")
            return here.step() if name in COLLECTION_STEPS else None
        return None

    def model_call(self, name: str, at: int, here: Context, args: list[tuple[int, int]]) -> Context | None:
        if name in ("setValue", "getValue") and args:
            write = name == "setValue"
            extra = len(args) - (2 if write else 1)
            level = {0: "header", 1: "entry", 2: "subentry"}.get(extra, "unknown")
            self.access(write, at, here.step(level=level), args[0], f"model.{name}")
            return here.step(kind="object", source="basedata", level="basedata") if not write else None
        if name in ("getEntryEntity", "getDynamicObjectCollection") and args:
            key = self.key(args[0])
            return here.step(kind="collection", level="entry", entry=key["key"])
        if name in ("getEntryRowEntity",) and args:
            return here.step(kind="object", level="entry", entry=self.key(args[0])["key"])
        return None

    def object_call(self, name: str, at: int, here: Context, args: list[tuple[int, int]]) -> Context | None:
        if name == "set" and len(args) == 2:
            self.access(True, at, here, args[0], "object.set")
        elif name in OBJECT_READS and len(args) == 1:
            key = self.key(args[0])
            if name == "getDynamicObjectCollection":
                level = {"header": "entry", "entry": "subentry"}.get(here.level, "unknown")
                return here.step(kind="collection", level=level, entry=key["key"])
            self.access(False, at, here, args[0], f"object.{name}")
            if name == "getDynamicObject":
                return here.step(source="basedata", level="basedata")
        elif name == "getParent":
            return here.step(level="header", entry=None) if here.level == "entry" else None
        elif name == "getDynamicObjectType":
            return here.step()
        return None

    def key(self, part: tuple[int, int]) -> dict:
        return key_of([self.r.t[k] for k in range(*part)], self.strings, self.loops)

    def access(self, write: bool, at: int, here: Context, part: tuple[int, int], via: str) -> None:
        known = here.source if here.source != "basedata" else None
        self.accesses.append(
            {
                "class_fqn": self.owner["fqn"], "method": self.method, "access": "write" if write else "read", **self.key(part),
                "source": known, "form": here.form, "level": here.level, "entry": here.entry, "param": here.param, "via": via, "receiver": self.operand,
                "line": self.r.t[at].line, "col": self.r.t[at].col,
            }
        )


def parse(source: str) -> Parsed:
    """Read a file; once more if methods return data objects that others may use."""
    first = Reader(source)
    found = first.read()
    if any(first.returns.values()):
        again = Reader(source)
        again.returns = dict(first.returns)
        found = again.read()
    return found
