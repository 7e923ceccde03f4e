"""Reversible encodings of JSON trees, record lists and XML.

An encoder takes the parsed value and gives the payload or None where it gives
up; a decoder takes the payload and gives the value. Shapes differ from row to
row, so this is Python in Arrow batches, a row at a time; memory is that of one
payload. Values are compared as canonical JSON, so 1, 1.0 and true differ.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from functools import lru_cache
from os.path import commonprefix

from pyspark.sql import Column

from foldmill.functions.rowwise import by_row
from foldmill.functions.text import marker

# Fixed values of the formats.
DELIMITERS = ["|", "\t", "¦", "~"]
ENUM_MOST, PREFIX_LEAST, SEQUENCE_LEAST = 64, 4, 3
TREE_CHARS, TREE_MOST = 40, 64
ATOM_CHARS, ATOM_COUNT, ATOM_MOST = 4, 3, 128

_BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, ET.ParseError)


#: One encoder for all values; json.dumps would make one for each.
dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_quoted = json.encoder.encode_basestring


def canonical(x) -> str:
    return json.dumps(x, sort_keys=True)


def _payload(name: str, *lines: str) -> str:
    return "\n".join([marker(name), *lines])


def _scalar(x) -> bool:
    return x is None or isinstance(x, (str, int, float, bool))


# Paths: steps are keys (str) or places (int).


def leaves(value) -> list[tuple[tuple, object]]:
    """(steps, value) of each leaf in document order; an empty container is a leaf."""
    out, todo = [], [((), value)]
    while todo:
        steps, x = todo.pop()
        if isinstance(x, dict) and x:
            todo.extend(((*steps, k), v) for k, v in reversed(x.items()))
        elif isinstance(x, list) and x:
            todo.extend(((*steps, i), x[i]) for i in range(len(x) - 1, -1, -1))
        else:
            out.append((steps, x))
    return out


@lru_cache(4096)
def path_text(steps: tuple) -> str:
    """$.a[0]["odd key"]: a key that isn't plain is quoted, so that each path reads back."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" if re.fullmatch(r"[\w-]+", s) else f"[{dump(s)}]" for s in steps)


_STEP = re.compile(r'\.([\w-]+)|\[(\d+)\]|\[("(?:[^"\\]|\\.)*")\]')


@lru_cache(4096)
def path_steps_of(text: str) -> tuple:
    """Steps of a whole path; those of a payload's head come again in every payload of its kind."""
    return path_steps(text)[0]


def path_steps(text: str) -> tuple[tuple, int]:
    """Steps of the path that ``text`` begins with, and where it ends."""
    steps, at = [], 1
    while m := _STEP.match(text, at):
        steps.append(m[1] if m[1] is not None else int(m[2]) if m[2] is not None else json.loads(m[3]))
        at = m.end()
    return tuple(steps), at


def from_leaves(pairs: list[tuple[tuple, object]]):
    """The tree that has these leaves, in any order."""
    root = [None]
    for steps, v in pairs:
        here, at = root, 0
        for s in steps:
            if here[at] is None:
                here[at] = [] if isinstance(s, int) else {}
            here, at = here[at], s
            if isinstance(here, list):
                here.extend([None] * (at + 1 - len(here)))
            else:
                here.setdefault(at, None)
        here[at] = v
    return root[0]


# Columns of records: what needs no cell is said once.


def squeeze(values: list) -> tuple[dict | None, list]:
    """A transform of a column and the cells that are left: int_sequence (cells null) or prefix (cells are the rest)."""
    if len(values) >= SEQUENCE_LEAST:
        if all(type(v) is int for v in values) and len({b - a for a, b in zip(values, values[1:])}) == 1:
            return {"kind": "int_sequence", "start": values[0], "step": values[1] - values[0]}, [None] * len(values)
        if all(isinstance(v, str) for v in values) and len(p := commonprefix(values)) >= PREFIX_LEAST:
            return {"kind": "prefix", "prefix": p}, [v[len(p) :] for v in values]
    return None, values


def stretch(t: dict, cells: list) -> list:
    if t["kind"] == "int_sequence":
        return [t["start"] + i * t["step"] for i in range(len(cells))]
    return [t["prefix"] + c for c in cells]


def _is_records(v) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(r, dict) for r in v)


def _cell(v, d: str) -> str:
    if v is None:
        return "∅"
    if isinstance(v, str):
        return "s:" + v.replace("\\", "\\\\").replace("\n", "\\n").replace(d, "\\" + d)
    return "n:" + dump(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "j:" + _cell(dump(v), d)[2:]


def _plain(cell: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], cell, flags=re.S)


def _cells(line: str, d: str) -> list[str]:
    """Cells between unescaped delimiters, still escaped."""
    return re.findall(rf"(?:^|{re.escape(d)})((?:[^\\{re.escape(d)}]|\\.)*)", line, flags=re.S)


def json_table(v, delimiters=DELIMITERS) -> str | None:
    """Records as delimited rows; the delimiter is the one that occurs least in keys and cells. Missing keys read back as null."""
    if not _is_records(v) or not any(v):
        return None
    keys = list(dict.fromkeys(k for r in v for k in r))
    seen = Counter(c for r in ([*keys], *([str(r.get(k, "")) for k in keys] for r in v)) for cell in r for c in cell)
    d = min(delimiters, key=lambda c: seen[c])
    rows = [d.join(_cell(r.get(k), d) for k in keys) for r in v]
    head = f'{marker("json_table")} delimiter="{d}" escape="\\" null="∅"'
    return "\n".join([head, d.join(_cell(k, d)[2:] for k in keys), *rows])


def json_table_decode(payload: str):
    head, keys, *rows = payload.split("\n")
    d = re.search('delimiter="(.)"', head)[1]
    keys = [_plain(k) for k in _cells(keys, d)]
    read = lambda c: None if c == "∅" else _plain(c[2:]) if c[0] == "s" else json.loads(_plain(c[2:]))
    return [dict(zip(keys, map(read, _cells(r, d)), strict=True)) for r in rows]


def schema_rows(v) -> str | None:
    """Records with the same scalar keys: constants and enums are said once, sequences and prefixes become transforms."""
    if not _is_records(v) or len(v) < 3 or any(r.keys() != v[0].keys() for r in v) or not all(_scalar(x) for r in v for x in r.values()):
        return None
    head, cells = {"columns": [], "constants": {}, "enums": {}, "transforms": {}}, []
    for k in v[0]:
        col = [r[k] for r in v]
        kinds = list(dict.fromkeys(map(dump, col)))
        if len(kinds) == 1:
            head["constants"][k] = col[0]
            continue
        if len(kinds) <= min(ENUM_MOST, max(2, len(col) // 2)) and all(x is None or isinstance(x, str) for x in col):
            place = {x: i for i, x in enumerate(kinds)}
            head["enums"][k] = [json.loads(x) for x in kinds]
            col = [place[dump(x)] for x in col]
        else:
            t, col = squeeze(col)
            if t:
                head["transforms"][k] = t
        head["columns"].append(k)
        cells.append(col)
    return _payload("schema_rows", dump(head), "@rows", *([dump(list(r)) for r in zip(*cells)] if cells else ["[]"] * len(v)))


def schema_rows_decode(payload: str):
    _, head, _, *rows = payload.split("\n")
    head, rows = json.loads(head), [json.loads(r) for r in rows]
    out = [dict(head["constants"]) for _ in rows]
    for i, k in enumerate(head["columns"]):
        col = [r[i] for r in rows]
        if k in head["enums"]:
            col = [head["enums"][k][c] for c in col]
        elif k in head["transforms"]:
            col = stretch(head["transforms"][k], col)
        for r, x in zip(out, col):
            r[k] = x
    return out


def _family(v):
    """The first place (breadth first) with three or more children, records all, whose leaves have the same paths."""
    todo = [((), v)]
    while todo:
        nxt = []
        for steps, x in todo:
            kids = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            if len(kids) >= 3 and all(isinstance(c, dict) and c for c in kids):
                shapes = [[s for s, _ in leaves(c)] for c in kids]
                if all(s == shapes[0] for s in shapes):
                    return steps, x, kids, shapes[0]
            pairs = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
            nxt.extend(((*steps, k), c) for k, c in pairs)
        todo = nxt
    return None


def shape_rows(v) -> str | None:
    """Nested children of one shape as rows of leaves; what lies beside them goes to extras."""
    found = _family(v)
    if not found:
        return None
    root, at, kids, shape = found
    table = [[x for _, x in leaves(c)] for c in kids]
    head = {"root_path": path_text(root), "count": len(kids), "paths": [], "constants": {}, "transforms": {}}
    cols = []
    for j, steps in enumerate(shape):
        col, name = [r[j] for r in table], path_text(steps)
        if len(set(map(dump, col))) == 1:
            head["constants"][name] = col[0]
            continue
        t, col = squeeze(col)
        if t:
            head["transforms"][name] = t
        head["paths"].append(name)
        cols.append(col)
    others = [(path_text(s), x) for s, x in leaves(v) if s[: len(root)] != root]
    if others:
        head["extras"] = others
    if isinstance(at, dict):
        head["child_keys"] = list(at)
    return _payload("shape_rows", dump(head), "@rows", *([dump(list(r)) for r in zip(*cols)] if cols else ["[]"] * len(kids)))


def shape_rows_decode(payload: str):
    _, head, _, *rows = payload.split("\n")
    head, rows = json.loads(head), [json.loads(r) for r in rows]
    cols = {p: [r[i] for r in rows] for i, p in enumerate(head["paths"])}
    for p, t in head["transforms"].items():
        cols[p] = stretch(t, cols[p])
    root = path_steps(head["root_path"])[0]
    pairs = [(path_steps(p)[0], x) for p, x in head.get("extras", [])]
    for i, child in enumerate(head.get("child_keys") or range(head["count"])):
        own = [(p, x) for p, x in head["constants"].items()] + [(p, c[i]) for p, c in cols.items()]
        pairs.extend(((*root, child, *path_steps(p)[0]), x) for p, x in own)
    return from_leaves(pairs)


def path_dict_rows(v) -> str | None:
    """Paths once, then [path, value] rows; where items of a list all have the first one's paths, a row for each item."""
    if not isinstance(v, (dict, list)) or len(own := leaves(v)) < 20:
        return None
    if _is_records(v):
        items = [dict(leaves(r)) for r in v]
        base = list(items[0])
        if all(all(s in r for s in base) for r in items):
            extras = [[i, path_text(s), x] for i, r in enumerate(items) for s, x in r.items() if s not in items[0]]
            return _payload("path_dict_rows", "mode=items", "extras=" + dump(extras), "paths=" + dump([path_text(s) for s in base]), "rows=" + dump([[r[s] for s in base] for r in items]))
    # Places in lists are part of the path, so a path occurs once; equal leaves of different items share the path's text up to the place.
    names = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in own))}
    return _payload("path_dict_rows", "root=" + ("list" if isinstance(v, list) else "dict"), "paths=" + dump([path_text(s) for s in names]), "rows=" + dump([[names[s], x] for s, x in own]))


def path_dict_rows_decode(payload: str):
    part = dict(x.split("=", 1) for x in payload.split("\n")[1:])
    paths, rows = [path_steps(p)[0] for p in json.loads(part["paths"])], json.loads(part["rows"])
    if part.get("mode") != "items":
        return from_leaves([(paths[i], x) for i, x in rows])
    items = [list(zip(paths, r)) for r in rows]
    for i, p, x in json.loads(part["extras"]):
        items[i].append((path_steps(p)[0], x))
    return [from_leaves(r) for r in items]


def _parts(v):
    """All subtrees, containers first."""
    todo = [v]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())


def tree_dict(v) -> str | None:
    """Containers that repeat are named T0, T1, ... and referred to. Gives up where the data uses $ref itself."""
    if not isinstance(v, (dict, list)) or len(dump(v)) < 700 or any(isinstance(x, dict) and "$ref" in x for x in _parts(v)):
        return None
    count = Counter(dump(x) for x in _parts(v) if isinstance(x, (dict, list)))
    worth = sorted(((n - 1) * len(t), t) for t, n in count.items() if n > 1 and len(t) > TREE_CHARS)[::-1][:TREE_MOST]
    if not worth:
        return None
    names = {t: f"T{i}" for i, (_, t) in enumerate(worth)}

    def fold(x, top=False):
        if isinstance(x, (dict, list)):
            if not top and (name := names.get(dump(x))):
                return {"$ref": name}
            return {k: fold(c) for k, c in x.items()} if isinstance(x, dict) else [fold(c) for c in x]
        return x

    return _payload("tree_dict", "dict=" + dump({n: fold(json.loads(t), True) for t, n in names.items()}), "root=" + dump(fold(v, True)))


def tree_dict_decode(payload: str):
    _, known, root = payload.split("\n")
    known = json.loads(known[5:])

    def unfold(x):
        if isinstance(x, dict):
            return unfold(known[x["$ref"]]) if x.keys() == {"$ref"} else {k: unfold(c) for k, c in x.items()}
        return [unfold(c) for c in x] if isinstance(x, list) else x

    return unfold(json.loads(root[5:]))


def atom_dict(v) -> str | None:
    """Strings and keys that repeat become atoms; an object is a list of pairs. Data in which a list would read back as an object is given up."""
    if not isinstance(v, (dict, list)) or len(dump(v)) < 500:
        return None
    found: Counter = Counter()
    for steps, x in leaves(v):
        found.update([x] if isinstance(x, str) else [])
        # A key counts once for each object that it stands in: where its first leaf is.
        found.update(s for i, s in enumerate(steps) if isinstance(s, str) and _first_leaf(v, steps, i))
    gain = {s: (n - 1) * len(s) for s, n in found.items() if len(s) >= ATOM_CHARS and n >= ATOM_COUNT and (n - 1) * len(s) > len(s) + 8}
    names = {s: f"@{i}" for i, s in enumerate(sorted(gain, key=gain.get, reverse=True)[:ATOM_MOST])}
    if not names:
        return None
    text = lambda s: {"$a": names[s]} if s in names else s

    def written(x):
        if isinstance(x, str):
            return text(x)
        if isinstance(x, dict):
            return [[text(k), written(c)] for k, c in x.items()]
        return [written(c) for c in x] if isinstance(x, list) else x

    out = _payload("atom_dict", dump({"atoms": {n: s for s, n in names.items()}, "root_type": type(v).__name__}), "root=" + dump(written(v)))
    return out if canonical(atom_dict_decode(out)) == canonical(v) else None


def _first_leaf(v, steps: tuple, i: int) -> bool:
    """Whether the leaf at ``steps`` is the first one below its ``i``-th step."""
    x = v
    for s in steps[: i + 1]:
        x = x[s]
    for s in steps[i + 1 :]:
        if s != (0 if isinstance(x, list) else next(iter(x))):
            return False
        x = x[s]
    return True


def _is_pairs(x: list) -> bool:
    return all(isinstance(p, list) and len(p) == 2 and isinstance(p[0], (str, dict)) for p in x)


def atom_dict_decode(payload: str):
    _, head, root = payload.split("\n")
    head = json.loads(head)
    atoms = head["atoms"]

    def read(x, as_list=False):
        if isinstance(x, dict):
            return atoms[x["$a"]]
        if not isinstance(x, list):
            return x
        if as_list or not _is_pairs(x):
            return [read(c) for c in x]
        return {read(k): read(c) for k, c in x}

    return read(json.loads(root[5:]), head["root_type"] == "list")


def json_path(v) -> str | None:
    """A line path=value for each leaf."""
    return _payload("json_path", *(f"{path_text(s)}={dump(x)}" for s, x in leaves(v))) if isinstance(v, (dict, list)) else None


def json_path_decode(payload: str):
    pairs = []
    for line in payload.split("\n")[1:]:
        steps, at = path_steps(line)
        pairs.append((steps, json.loads(line[at + 1 :])))
    return from_leaves(pairs)


# XML; texts that declare a document type are refused, since entities could grow without bound.


def _xml(text: str) -> ET.Element:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document type")
    return ET.fromstring(text)


#: Elements or lines of an XML text whose form (all but the values) is kept for texts of the same form; larger ones seldom repeat.
XML_FORM = 64


def xml_path(text: str) -> str | None:
    """A line for each attribute and text, with the place among siblings of the tag. Elements without either, and space between elements, aren't in it."""
    if not (text.lstrip().startswith("<") and text.endswith(">")):
        return None
    all_of = list(_xml(text).iter())
    form = tuple([(e.tag, len(e)) for e in all_of])
    out = []
    for path, e in zip(_xml_places(form) if len(form) <= XML_FORM else _xml_places.__wrapped__(form), all_of):
        for k, v in e.items():
            out.append(f"{path}/@{k}={v}")
        if (value := e.text) and (value := value.strip()):
            out.append(f"{path}/text()={value}")
    return _payload("xml_path", *out)


@lru_cache(1024)
def _xml_places(form: tuple) -> list[str]:
    """Paths of elements, from their tags and numbers of children in the order of the text."""
    out, above = [], []
    for tag, kids in form:
        while above and not above[-1][1]:
            above.pop()
        path = f"/{tag}[0]"
        if above:
            up, _, seen = above[-1]
            above[-1][1] -= 1
            n = seen.get(tag, 0)
            path, seen[tag] = f"{up}/{tag}[{n}]", n + 1
        out.append(path)
        above.append([path, kids, {}])
    return out


_XML_LINE = re.compile(r"((?:/[^/\[\]=]+\[\d+\])+)(?:/@([^=]+)|/text\(\))=(.*)", re.S)
_XML_STEP = re.compile(r"/([^/\[\]]+)\[(\d+)\]")


def xml_path_decode(payload: str) -> str:
    """The elements, attributes and stripped texts that the lines name; space between elements doesn't come back."""
    lines = payload.split("\n")[1:]
    if len(lines) <= XML_FORM:
        cut = [x.partition("=") for x in lines]
        form = _xml_form(tuple([x[0] for x in cut]))
        form[0] += 1
        # A form that comes again is worth its making.
        if form[0] == 2:
            form[1] = _xml_filling([x[0] for x in cut])
        if form[1] is not None and "" not in [x[1] for x in cut]:
            fixed, slots = form[1]
            out = [fixed[0]]
            for (i, is_text), after in zip(slots, fixed[1:]):
                value = cut[i][2]
                if not value.isalnum():
                    if is_text and not value:  # an element without text is written in another way
                        return _xml_path_back(lines)
                    value = ET._escape_cdata(value) if is_text else ET._escape_attrib(value)
                out += (value, after)
            return "".join(out)
    return _xml_path_back(lines)


@lru_cache(1024)
def _xml_form(heads: tuple) -> list:
    """How often payloads with these lines before the = have come, and what _xml_filling makes of them."""
    return [0, None]


#: A letter that marks places of values.
_SLOT = "\U00010380"


def _xml_filling(heads: list[str]) -> tuple[list[str], list[tuple[int, bool]]] | None:
    """The written text around the values, and for each place the line that has its value and whether it is a text; None where a value has no place of its own."""
    if any(_SLOT in h for h in heads):
        return None
    lines = [f"{h}={_SLOT}{i}{_SLOT}" for i, h in enumerate(heads)]
    found = [_XML_LINE.match(x) for x in lines]
    if not lines or None in found:
        return None
    parts = re.split(f"{_SLOT}([0-9]+){_SLOT}", _xml_path_back(lines))
    slots = [int(i) for i in parts[1::2]]
    return (parts[::2], [(i, found[i][2] is None) for i in slots]) if sorted(slots) == list(range(len(lines))) else None


def _xml_path_back(lines: list[str]) -> str:
    root = None
    known: dict[str, ET.Element] = {}
    for line in lines:
        whole, name, value = _XML_LINE.match(line).groups()
        # A path is known by its text, and may be written in another way than it is made here.
        if (e := known.get(whole)) is None:
            path = ""
            for tag, place in _XML_STEP.findall(whole):
                up, path = path, f"{path}/{tag}[{place}]"
                if path not in known:
                    known[path] = ET.SubElement(known[up], tag) if up else ET.Element(tag)
                    root = root if root is not None else known[path]
            e = known[path]
        if name:
            e.set(name, value)
        else:
            e.text = value
    return _xml_text(root)


def _xml_text(e: ET.Element) -> str:
    """As ET.tostring writes it, which also takes the names with namespaces."""
    out: list[str] = []

    def add(e: ET.Element) -> bool:
        if e.tag[0:1] == "{" or any(k[0:1] == "{" for k in e.attrib):
            return False
        _open(out, e.tag, e.attrib, e.text, len(e))
        if not all(map(add, e)):
            return False
        _close(out, e.tag, e.text, e.tail, len(e))
        return True

    return "".join(out) if add(e) else ET.tostring(e, encoding="unicode")


def _open(out: list[str], tag: str, attrib: dict, text: str | None, kids) -> None:
    out.append("<" + tag)
    for k, v in attrib.items():
        out.append(f' {k}="{v if v.isalnum() else ET._escape_attrib(v)}"')
    if text or kids:
        out.append(">")
        if text:
            out.append(text if text.isalnum() else ET._escape_cdata(text))


def _close(out: list[str], tag: str, text: str | None, tail: str | None, kids) -> None:
    out.append(f"</{tag}>" if text or kids else " />")
    if tail:
        out.append(tail if tail.isalnum() else ET._escape_cdata(tail))


def _xml_tree(e: ET.Element) -> list:
    return [e.tag, dict(e.attrib), e.text, e.tail, [_xml_tree(c) for c in e]]


def _xml_element(x: list) -> ET.Element:
    e = ET.Element(x[0], x[1])
    e.text, e.tail = x[2], x[3]
    e.extend(map(_xml_element, x[4]))
    return e


def _xml_leaves(e: ET.Element, shape: list, values: list) -> None:
    """Adds the values of leaves(_xml_tree(e)), and to ``shape`` what decides their paths: names of attributes and numbers of children."""
    values.append(e.tag)
    a = e.attrib
    shape.append(tuple(a))
    if a:
        values.extend(a.values())
    else:
        values.append(a)
    values += (e.text, e.tail)
    shape.append(len(e))
    if len(e):
        for c in e:
            _xml_leaves(c, shape, values)
    else:
        values.append([])


@lru_cache(1024)
def _xml_paths(shape: tuple) -> list[str]:
    """Path texts of the leaves of an element of that shape."""
    todo = iter(shape)

    def tree() -> list:
        names = next(todo)
        return ["", dict.fromkeys(names), None, None, [tree() for _ in range(next(todo))]]

    return [path_text(s) for s, _ in leaves(tree())]


def xml_shape_rows(text: str) -> str | None:
    """Children of one shape as rows of their attributes and texts, beside one template."""
    root = _xml(text)
    kids = list(root)
    if len(kids) < 3 or len({k.tag for k in kids}) > 1:
        return None
    shape, table = None, []
    for k in kids:
        own, values = [], []
        _xml_leaves(k, own, values)
        if shape is not None and own != shape:
            return None
        shape = own
        table.append(values)
    paths, cols = _xml_paths(tuple(shape)), list(zip(*table))
    # At one place all values are texts or null, or all are empty.
    fixed = [c.count(c[0]) == len(c) for c in cols]
    head = {"root_tag": root.tag, "root_attrib": root.attrib, "root_text": root.text, "child_template": kids[0].tag, "paths": [p for p, f in zip(paths, fixed) if not f], "constants": {p: c[0] for p, f, c in zip(paths, fixed, cols) if f}, "tail": root.tail}
    cells = [[_quoted(x) if x is not None else "null" for x in c] for c, f in zip(cols, fixed) if not f]
    return _payload("xml_shape_rows", dump(head), "@rows", *([f"[{','.join(r)}]" for r in zip(*cells)] if cells else ["[]"] * len(kids)))


@lru_cache(1024)
def _xml_template(paths: tuple):
    """The tree that has these paths, with the number of each at its place; None where the paths aren't those of an element's tree."""
    try:
        out = from_leaves([(path_steps_of(p), i) for i, p in enumerate(paths)])
    except _BROKEN:
        return None

    def sound(x) -> bool:
        return type(x) is list and len(x) == 5 and all(type(x[i]) is int for i in (0, 2, 3)) and (type(x[1]) is int or type(x[1]) is dict and all(type(i) is int for i in x[1].values())) and (type(x[4]) is int or type(x[4]) is list and all(map(sound, x[4])))

    return out if sound(out) else None


def _xml_filled(out: list[str], x: list, v: list) -> bool:
    """Writes a template with its values; False where they aren't those of a plain element."""
    tag, text, tail, attrib, kids = v[x[0]], v[x[2]], v[x[3]], x[1], x[4]
    attrib = {k: v[i] for k, i in attrib.items()} if type(attrib) is dict else v[attrib]
    kids = kids if type(kids) is list else v[kids]
    if type(tag) is not str or type(attrib) is not dict or type(kids) is not list or (type(x[4]) is int and kids) or tag[0:1] == "{" or any(k[0:1] == "{" or type(s) is not str for k, s in attrib.items()) or not (text is None or type(text) is str) or not (tail is None or type(tail) is str):
        return False
    _open(out, tag, attrib, text, kids)
    for k in kids:
        if not _xml_filled(out, k, v):
            return False
    _close(out, tag, text, tail, kids)
    return True


def xml_shape_rows_decode(payload: str) -> str:
    _, head, _, *rows = payload.split("\n")
    head = json.loads(head)
    rows = [json.loads(r) for r in rows]
    same, names = list(head["constants"].values()), (*head["constants"], *head["paths"])
    root = [head["root_tag"], head["root_attrib"], head["root_text"], head["tail"]]
    template, out = _xml_template(names), []
    plain = template is not None and len(set(names)) == len(names) and all(len(r) == len(head["paths"]) for r in rows)
    if plain and type(root[0]) is str and root[0][0:1] != "{" and not any(k[0:1] == "{" or type(s) is not str for k, s in root[1].items()):
        _open(out, *root[:3], rows)
        if all(_xml_filled(out, template, [*same, *r]) for r in rows):
            _close(out, root[0], root[2], root[3], rows)
            return "".join(out)
    kids = [from_leaves([(path_steps_of(p), x) for p, x in [*head["constants"].items(), *zip(head["paths"], r)]]) for r in rows]
    return ET.tostring(_xml_element([*root, kids]), encoding="unicode")


#: Encoders and decoders of parsed JSON; of XML text, compared in canonical form.
JSON = {
    "shape_rows": (shape_rows, shape_rows_decode), "schema_rows": (schema_rows, schema_rows_decode), "tree_dict": (tree_dict, tree_dict_decode),
    "path_dict_rows": (path_dict_rows, path_dict_rows_decode), "atom_dict": (atom_dict, atom_dict_decode), "json_table": (json_table, json_table_decode), "json_path": (json_path, json_path_decode),
}


def encode(kind: str, text: str | None) -> str | None:
    """Payload of a text, or None where it isn't JSON (XML) or the encoding gives up."""
    try:
        if text is None:
            return None
        if kind in JSON:
            return JSON[kind][0](json.loads(text))
        return {"xml_path": xml_path, "xml_shape_rows": xml_shape_rows}[kind](text)
    except _BROKEN:
        return None


def decode(kind: str, payload: str | None) -> str | None:
    """Text of the value: compact JSON, or XML."""
    try:
        if payload is None:
            return None
        return dump(JSON[kind][1](payload)) if kind in JSON else {"xml_path": xml_path_decode, "xml_shape_rows": xml_shape_rows_decode}[kind](payload)
    except _BROKEN:
        return None


def round_trip(kind: str, text: str | None, payload: str | None) -> bool | None:
    if payload is None:
        return None
    back = decode(kind, payload)
    try:
        if kind in JSON:
            return back is not None and canonical(json.loads(back)) == canonical(json.loads(text))
        return back is not None and ET.canonicalize(back) == ET.canonicalize(text)
    except _BROKEN:
        return False


def encoded(kind: str, text: Column) -> Column:
    return by_row(lambda t: encode(kind, t), "string", text)


def decoded(kind: str, payload: Column) -> Column:
    return by_row(lambda p: decode(kind, p), "string", payload)


def verified(kind: str, text: Column, payload: Column) -> Column:
    return by_row(lambda t, p: round_trip(kind, t, p), "boolean", text, payload)
