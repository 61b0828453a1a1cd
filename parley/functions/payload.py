"""JSON bodies of the service (H-10): requests and model replies.

A request is an object with a field ``response``, the dialogue; a reply of
the hosted model an array whose first object has ``generated_text``. Bodies
come from outside, so each gives a value or the reason why not:

========================================  =================
body                                      error
========================================  =================
NULL or white space                       ``empty``
not one JSON value                        ``malformed``
another kind of value (``[..]``, ``5``)   ``wrong_type``
reply without an element (``[]``)         ``no_reply``
field missing or null                     ``missing_field``
field a number, object, array             its JSON text, no error
field twice                               the last one, no error
========================================  =================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import _c, strip_ws

REQUEST_FIELD, REPLY_FIELD = "response", "generated_text"
_BAD = {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}


def _parsed(body: Column, type_: str) -> Column:
    """``value`` and ``bad`` of one body. It is parsed as the member of an
    object, so that what follows a complete value is not passed over."""
    return F.from_json(F.concat(F.lit('{"value":'), body, F.lit("}")), f"value {type_}, bad string", _BAD)


def _one_value(body: Column) -> Column:
    """Whether the body is one JSON value, not several with commas."""
    return F.size(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")) == 1


def _result(body: Column, opens: str, type_: str, value) -> Column:
    body = strip_ws(body)
    got = _parsed(body, type_)
    text = value(got["value"])
    error = F.when(body.isNull() | (body == ""), "empty") \
        .when(~F.coalesce(_one_value(body), F.lit(False)), "malformed") \
        .when(~body.startswith(opens) | got["bad"].isNotNull(), "wrong_type")
    if opens == "[":
        error = error.when(F.size(got["value"]) == 0, "no_reply")
    error = error.when(text.isNull(), "missing_field")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def request_text(body) -> Column:
    """Struct (text, error) of a request body."""
    return _result(_c(body), "{", f"struct<{REQUEST_FIELD}:string>", lambda v: v[REQUEST_FIELD])


def reply_text(body) -> Column:
    """Struct (text, error) of a reply body: the first element's text."""
    return _result(_c(body), "[", f"array<struct<{REPLY_FIELD}:string>>", lambda v: F.get(v, F.lit(0))[REPLY_FIELD])
