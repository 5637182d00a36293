"""Tool calls that a model wrote as plain text, such as ``fetch_tsb(id="10")``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# A quoted keyword argument: a name, an equals sign, and a value that runs to the next quote of its
# own kind; a backslash takes the sign after it along.
_ARGUMENT = r"""(\w+)\s*=\s*(["'])((?:\\.|(?!\2)[^\\])*)\2"""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: an expression that mentions another one twice works it out twice."""
    return F.transform(F.array(value), use)[0]


def _parts(call: Column) -> Column:
    """``struct(name, body)`` of a text that ends with a bracket, cut at its first opening one."""
    opened = F.instr(call, "(")
    name = strip(F.substr(call, F.lit(1), F.greatest(opened - 1, F.lit(0))))
    body = strip(F.substr(call, opened + 1, F.length(call) - opened - 1))
    return F.when((opened > 0) & F.endswith(call, F.lit(")")), F.struct(name.alias("name"), body.alias("body")))


def _arguments(body: Column) -> Column:
    from_object = F.when(F.startswith(body, F.lit("{")), F.from_json(body, "map<string,string>"))
    keys, values = (F.regexp_extract_all(body, F.lit(_ARGUMENT), F.lit(group)) for group in (1, 3))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))

    def last(pairs: Column) -> Column:
        return F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda later: later["key"] == p["key"])
        )

    return F.coalesce(from_object, _let(pairs, lambda found: F.when(F.size(found) > 0, F.map_from_entries(last(found)))))


def textual_call(text: Column | str, allowed: tuple[str, ...]) -> Column:
    """``struct(name, args)`` when the whole text is one call to an allowed name, else NULL.

    Arguments come from a JSON object or from quoted keywords; a repeated keyword keeps its
    last value. A call without readable arguments is no call.
    """
    text = F.col(text) if isinstance(text, str) else text

    def read(call: Column) -> Column:
        whole = call["name"].rlike(r"\A\w+\z") & call["name"].isin(*allowed)
        told = _let(_arguments(call["body"]), lambda args: F.when(args.isNotNull(), F.struct(call["name"].alias("name"), args.alias("args"))))
        return F.when(whole, told)

    return _let(_let(strip(text), _parts), read)
