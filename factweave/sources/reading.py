"""JSON of model output read by its types, a batch of texts at a time: the readers of ``typed`` for whole payloads.

Numbers are doubles. A reader gives what a field's value is, or raises ``Malformed`` if the field can't hold it: a missing field and
a JSON null conform, a number of no finite size does not. An object that repeats a key is malformed, and so is what trails after a value.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from typing import Any

Reader = Callable[[Any], Any]


class Malformed(ValueError):
    """A value that its field can't hold."""


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Malformed("a key is repeated")
    return found


def _refused(name: str) -> Any:
    raise Malformed(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=float, parse_constant=_refused)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?")
_NO_DIGIT, _WHOLE = re.compile("[^0-9-]"), re.compile("-?[0-9]+")
_SURROGATE = re.compile("[\ud800-\udfff]")


def parsed(text: str | None) -> Any:
    """The value of a text that is one JSON value; raises ``Malformed``."""
    try:
        value = _DECODER.decode(text or "")
    except (ValueError, RecursionError) as e:
        raise Malformed(str(e)) from None
    return value


def plain(text: str) -> str:
    """Half a surrogate pair, which JSON can spell, has no UTF-8."""
    return _SURROGATE.sub("?", text)


def number_text(x: float) -> str:
    """A double as the language of the web writes it: shortest digits, an exponent from 1e21 up and below 1e-6."""
    if not math.isfinite(x):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x.is_integer() and abs(x) < 2**53:
        return str(int(x))
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, rest = mantissa.partition(".")
    digits = (whole + rest).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + rest) - len(digits))
    digits, sign = digits.rstrip("0"), "-" if x < 0 else ""
    if point > 21 or point < -5:
        return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    if point >= len(digits):
        return sign + digits.ljust(point, "0")
    return sign + (f"{digits[:point]}.{digits[point:]}" if point > 0 else f"0.{'0' * -point}{digits}")


def verbatim(v: Any) -> str | None:
    """Texts and finite numbers, as text."""
    if type(v) is str:
        return v if v.isascii() else plain(v)
    if v is None:
        return None
    if type(v) is float and math.isfinite(v):
        return number_text(v)
    raise Malformed


def verbatim_filled(v: Any) -> str:
    return "" if v is None else verbatim(v)  # type: ignore[return-value]


def soft_text(v: Any) -> str | None:
    return None if v is None else verbatim(v).strip(" ")  # type: ignore[union-attr]


def required(v: Any) -> str:
    """A text that is "" where it is missing, so that its item can still be reviewed."""
    return "" if v is None else verbatim(v).strip(" ")  # type: ignore[union-attr]


def _finite(digits: re.Match[str] | None) -> float | None:
    x = float(digits[0]) if digits else math.inf
    return x if math.isfinite(x) else None


def leading_number(text: str) -> float | None:
    """The number a text begins with; None if it begins with none or with one of no finite size."""
    return _finite(_NUMBER.match(text.lstrip(" ")))


def _number(v: Any, of_text: Callable[[str], float | None]) -> float | None:
    if v is None:
        return None
    if type(v) is str:
        return of_text(v)
    if type(v) is float and math.isfinite(v):
        return v
    raise Malformed


def soft_int(v: Any) -> float | None:
    """Finite numbers as they are, and the digits of texts; ``3-4`` is 3."""
    return _number(v, lambda t: _finite(_WHOLE.match(_NO_DIGIT.sub("", t))))


def soft_number(v: Any) -> float | None:
    """Finite numbers, and those that texts begin with."""
    return _number(v, leading_number)


def soft_flag(v: Any) -> bool:
    """Flags and texts; true are the flag and the text true alone."""
    if v is None or type(v) in (str, bool):
        return v is True or v == "true"
    raise Malformed


def any_text(v: Any) -> str:
    """Any value as a text that joins arrays by commas, as a cast to text does there; objects have no text of their own."""
    if v is None:
        return ""
    if type(v) is list:
        return ",".join(map(any_text, v))
    if type(v) is dict:
        return "[object Object]"
    return plain(v) if type(v) is str else number_text(v) if type(v) is float else str(v).lower()


def _listed(v: Any) -> list[Any]:
    if v is not None and type(v) is not list:
        raise Malformed
    return v or []


def soft_numbers(v: Any) -> list[float]:
    """An array of anything as numbers: what is none, or of no finite size, is 0. Only arrays conform."""
    found = (x if type(x) is float else leading_number(any_text(x)) for x in _listed(v))
    return [x if x is not None and math.isfinite(x) else 0.0 for x in found]


def soft_texts(v: Any) -> list[str]:
    """An array of anything as texts. Only arrays conform."""
    return [any_text(x) for x in _listed(v)]


Fields = list[tuple[str, str, Reader]]


def fields(readers: dict[str, Reader]) -> Fields:
    """Fields that keep their names."""
    return [(name, name, read) for name, read in readers.items()]


def record(v: Any, taken: Fields) -> dict[str, Any]:
    """Fields (new name, name, reader) of an object; it conforms if it is one and all of them do."""
    if type(v) is not dict:
        raise Malformed
    get = v.get
    return {to: read(get(name)) for to, name, read in taken}


def records(v: Any, taken: Fields) -> list[dict[str, Any]]:
    """The conforming objects of an array, each judged alone; the others go."""
    out = []
    for each in v if type(v) is list else ():
        try:
            out.append(record(each, taken))
        except Malformed:
            continue
    return out
