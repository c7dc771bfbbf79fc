"""JSON in strings: what the VARIANT functions cannot do, as Arrow functions over whole columns.

Plain look-ups with a constant path are better done by ``try_variant_get`` or ``get_json_object`` in the JVM; these functions keep
the difference of booleans, integers and floats, the order of keys and the difference of null and missing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arguments that are prose and say nothing about which call was made. Fixed values.
FREE_TEXT = {"answer": ("text",)}
_ABSENT = object()
#: A place in a list, in a pointer: digits, no sign, at most as many as a list can have.
_PLACE = re.compile("[0-9]{1,18}")
_DECODER = json.JSONDecoder()


def _first(text: str | None, opening: str, accept: Callable[[object], bool]) -> str | None:
    """The JSON value that begins at the first ``opening``, as it is written, if it is complete and accepted."""
    at = text.find(opening) if text else -1
    if at < 0:
        return None
    try:
        value, end = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None
    return text[at:end] if accept(value) else None


def _loads(text: str | None):
    if text is None:
        return _ABSENT
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _ABSENT


def _calls(text: str | None) -> list[dict] | None:
    value = _loads(text)
    value = [value] if isinstance(value, dict) else value
    return value if isinstance(value, list) and all(isinstance(x, dict) for x in value) else None


def _flat(value) -> str:
    """One text for equal values: numbers by value, booleans apart from them, texts stripped, keys in order."""
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, (int, float)):
        try:
            return repr(float(value))
        except OverflowError:
            return str(value)
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        return "{" + " ".join(f"{k} {_flat(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + " ".join(map(_flat, value)) + "]"
    return "null"


def _signature(call: dict, lexical: bool) -> str:
    name = call.get("name")
    arguments = call.get("arguments")
    arguments = arguments if isinstance(arguments, dict) else {}
    if lexical:
        return " ".join([str(name), *(f"{k} {str(arguments[k]).strip()}" for k in sorted(arguments))])
    prose = FREE_TEXT.get(name, ()) if isinstance(name, str) else ()
    return " ".join([str(name), *(f"{k} {_flat(arguments[k])}" for k in sorted(arguments) if k not in prose)])


def _tokens(pointer: str | None) -> list[str] | None:
    if pointer is None or (pointer and pointer[0] != "/"):
        return None
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def _step(node, token: str):
    if isinstance(node, dict):
        return node.get(token, _ABSENT)
    if isinstance(node, list) and _PLACE.fullmatch(token):
        return node[int(token)] if int(token) < len(node) else _ABSENT
    return _ABSENT


def _at(document: str | None, pointer: str | None):
    node, tokens = _loads(document), _tokens(pointer)
    for t in tokens or ():
        node = _step(node, t)
    return _ABSENT if tokens is None else node


def _put(document: str | None, pointer: str | None, value: str | None) -> str | None:
    root, tokens, new = _loads(document), _tokens(pointer), _loads(value)
    if not tokens or new is _ABSENT or _at(document, pointer) is _ABSENT:
        return None
    node = root
    for t in tokens[:-1]:
        node = _step(node, t)
    node[tokens[-1] if isinstance(node, dict) else int(tokens[-1])] = new
    return dumps(root)


def dumps(value) -> str:
    """Compact JSON; characters beyond ASCII stay."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def _different(a, b) -> list[str]:
    """Shallowest pointers at which two values differ, in order; an explicit stack instead of recursion."""
    out, stack = [], [("", a, b)]
    while stack:
        path, x, y = stack.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            for k in x.keys() | y.keys():
                stack.append((f"{path}/{_escape(k)}", x.get(k, _ABSENT), y.get(k, _ABSENT)))
        elif isinstance(x, list) and isinstance(y, list) and len(x) == len(y):
            stack += [(f"{path}/{i}", *xy) for i, xy in enumerate(zip(x, y))]
        elif isinstance(x, bool) is not isinstance(y, bool) or x is _ABSENT or y is _ABSENT or x != y:
            if x is not y:
                out.append(path)
    return sorted(out)


def _leaves(value) -> list[str]:
    """Pointers of all leaves; the places of a list are one, '#'."""
    out, stack = set(), [("", value)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict) and x:
            stack += [(f"{path}/{_escape(k)}", v) for k, v in x.items()]
        elif isinstance(x, list) and x:
            stack += [(f"{path}/#", v) for v in x]
        else:
            out.add(path)
    return sorted(out)


def _kind(value) -> str:
    for kind, of in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("object", dict), ("array", list)):
        if isinstance(value, of):
            return kind
    return "null"


def _call_fault(call, tools: dict[str, dict]) -> str | None:
    """The first thing that is wrong with a call: shape, tool, required arguments, then each argument's name and type."""
    if not isinstance(call, dict) or not isinstance(call.get("name"), str) or not isinstance(call.get("arguments", {}), dict):
        return "bad_shape"
    tool = tools.get(call["name"])
    if tool is None:
        return "undefined_tool"
    p = tool.get("parameters")
    given = call.get("arguments", {})
    known = p.get("properties", {}) if isinstance(p, dict) else {x: {} for x in p or ()}
    needed = p.get("required", ()) if isinstance(p, dict) else ()
    if any(x not in given for x in needed):
        return "missing_required_arg"
    for k, v in given.items():
        if k not in known:
            return "unknown_arg"
        want, have = known[k].get("type"), _kind(v)
        if want in ("boolean", "integer", "number", "string", "object", "array") and have != want and (have, want) != ("integer", "number"):
            return "bad_arg_type"
    return None


def _calls_fault(calls: str | None, tools: str | None) -> str | None:
    """Null for a list of one or more calls that fit the tools offered, else the first fault."""
    got = _calls(calls)
    if got is None:
        return "no_response"
    if not got:
        return "empty_calls"
    offered = _loads(tools)
    by_name = {t["name"]: t for t in offered if isinstance(t, dict) and isinstance(t.get("name"), str)} if isinstance(offered, list) else {}
    by_name.setdefault("answer", {"name": "answer", "parameters": ["text"]})
    return next((f for c in got if (f := _call_fault(c, by_name))), None)


def _turn_faults(calls, tools: str | None) -> list[str | None] | None:
    return None if calls is None else [_calls_fault(c, tools) for c in calls]


def _plain(x):
    """A cell as a Python value; missing cells come as None, NaN or NA, lists as arrays."""
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return None
    return x


def _arrow(kind, f: Callable) -> Callable[..., Column]:
    """A function of Python values as a function of columns, called batch by batch."""

    def series(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*(_plain(x) for x in row)) for row in zip(*columns)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return series(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return series(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return series(a, b, c)

    n = f.__code__.co_argcount
    return F.pandas_udf({1: one, 2: two, 3: three}[n], kind)


def _first_arguments(calls) -> dict:
    c = _calls(calls)
    arguments = c[0].get("arguments") if c else None
    return arguments if isinstance(arguments, dict) else {}


def _string_arguments(calls):
    return [v for v in _first_arguments(calls).values() if isinstance(v, str)]


def _argument_values(calls):
    return [str(v) for v in _first_arguments(calls).values()]


_STRING, _STRINGS, _BOOL = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType()


def _pointer_get(document, pointer):
    x = _at(document, pointer)
    return None if x is _ABSENT else dumps(x)


def _diff(a, b):
    return _different(_loads(a), _loads(b))


def _canonical(calls):
    c = _calls(calls)
    return None if c is None else [_signature(x, False) for x in c]


def _lexical(calls):
    c = _calls(calls)
    return None if c is None else [_signature(x, True) for x in c]


def _names(calls):
    c = _calls(calls)
    return None if c is None else [str(x.get("name")) for x in c]


def _object(text):
    return _first(text, "{", lambda v: isinstance(v, dict))


def _call(text):
    return _first(text, "[", lambda v: isinstance(v, list) and bool(v) and isinstance(v[0], dict) and "name" in v[0])


def _exists(document, pointer):
    return _at(document, pointer) is not _ABSENT


def _paths(document):
    x = _loads(document)
    return None if x is _ABSENT else _leaves(x)


def _sorted(document):
    x = _loads(document)
    return document if x is _ABSENT else json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


#: The first complete JSON object in free text; null if it is cut or not an object.
extract_object = _arrow(_STRING, _object)
#: The first complete JSON list in free text whose first element is a call.
first_calls = _arrow(_STRING, _call)
#: One text per call that is equal for equal calls: numbers by value, prose arguments left out. Null if it is no list of calls.
canonical_calls = _arrow(_STRINGS, _canonical)
#: The same, but arguments as they print: 500 and 500.0 differ.
lexical_calls = _arrow(_STRINGS, _lexical)
#: Names of the calls.
call_names = _arrow(_STRINGS, _names)
#: Arguments of the first call that are texts, and all of them as text.
string_arguments = _arrow(_STRINGS, _string_arguments)
argument_values = _arrow(_STRINGS, _argument_values)
#: (calls, tools): null if all calls fit the tools, else the first fault.
calls_fault = _arrow(_STRING, _calls_fault)
#: (calls of several turns, tools): the fault of each.
turn_faults = _arrow(_STRINGS, _turn_faults)
#: (document, pointer): the value as JSON; 'null' if it is null, null if it is missing.
pointer_get = _arrow(_STRING, _pointer_get)
#: (document, pointer): whether it resolves.
pointer_exists = _arrow(_BOOL, _exists)
#: (document, pointer, value): a copy with the value replaced; null if it doesn't resolve or is the root.
pointer_put = _arrow(_STRING, _put)
#: (a, b): shallowest pointers at which two documents differ.
diff_paths = _arrow(_STRINGS, _diff)
#: Pointers of all leaves, list places as '#'.
leaf_paths = _arrow(_STRINGS, _paths)
#: JSON with sorted keys; text that is no JSON stays.
sorted_json = _arrow(_STRING, _sorted)


def _seed(ids, base):
    if ids is None or base is None:
        return None
    digest = hashlib.blake2b(f"{int(base)}\0".encode() + "\0".join(ids).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") % (2**31 - 1)


#: (ids, base): a 31-bit seed that depends on the ids of a batch, not on its place.
batch_seed = _arrow(T.LongType(), _seed)
