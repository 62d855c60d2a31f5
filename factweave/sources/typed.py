"""JSON with its types: values are read as VARIANT, so that a number, a text, a flag and an object stay apart.

Functions take and give SQL text, to be used through ``expr`` or in one another: long expressions over nested values are parsed at once
where they run. A reader tells whether a field's value conforms, and what it is then: ``struct<ok, value>``. A missing field and a
JSON null conform and are null; a number of no finite size does not. An object that repeats a key is malformed.
"""

from __future__ import annotations

from collections.abc import Callable

Reader = Callable[[str], str]

#: Numbers of at most 15 digits without an exponent: a double is written just so.
_PLAIN = r"^(?!-?0[.]000000|-0$)-?(?=[0-9.]{1,16}$)(?:0|[1-9][0-9]*)(?:[.][0-9]*[1-9])?$"
#: Tokens of compact JSON: a text, a number, or what stands between.
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
#: Schema of an object whose fields are all texts, nulls or numbers written plainly.
_FLAT = r"^OBJECT<(?:[^<>:]+: (?:STRING|VOID|BIGINT|DECIMAL[(](?:[0-9]|1[0-5]),[0-6][)])(?:, )?)*>$"


def let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parsed(text: str) -> str:
    """The variant of a text that is one JSON value, else null."""
    # In brackets, since the parser stops at the end of a first value and would not see what follows it.
    every = f"try_variant_get(try_parse_json(concat('[', {text}, ']')), '$', 'array<variant>')"
    return let(every, "alone", "if(size(alone) = 1, get(alone, 0), null)")


def member(value: str, name: str) -> str:
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def absent(value: str) -> str:
    """Missing or null."""
    return f"({value} IS NULL OR is_variant_null({value}))"


def listed(value: str) -> str:
    """Elements of an array, null for what is none. The kind of a large value would be its whole schema, so it isn't asked for."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def elements(value: str) -> str:
    return f"coalesce({listed(value)}, CAST(array() AS ARRAY<VARIANT>))"


def is_object(value: str) -> str:
    return f"(try_variant_get({value}, '$', 'map<string,variant>') IS NOT NULL)"


def kind(value: str) -> str:
    """MISSING, VOID, STRING, NUMBER, BOOLEAN, ARRAY or OBJECT."""
    named = f"substring_index(substring_index(coalesce(schema_of_variant({value}), 'MISSING'), '<', 1), '(', 1)"
    return let(named, "named", "if(named IN ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT'), 'NUMBER', named)")


def number_text(x: str) -> str:
    """A double as the language of the web writes it: shortest digits, an exponent from 1e21 up and below 1e-6."""
    sign, point, digits = f"if({x} < 0, '-', '')", "d.point", "d.digits"
    odd = f"concat(left({digits}, 1), if(length({digits}) > 1, concat('.', substr({digits}, 2)), ''), if({point} > 0, 'e+', 'e-'), abs({point} - 1))"
    usual = f"CASE WHEN {point} >= length({digits}) THEN rpad({digits}, {point}, '0') WHEN {point} > 0 THEN concat(left({digits}, {point}), '.', substr({digits}, {point} + 1)) ELSE concat('0.', repeat('0', -{point}), {digits}) END"
    written = f"concat({sign}, CASE WHEN {digits} = '' THEN '0' WHEN {point} > 21 OR {point} < -5 THEN {odd} ELSE {usual} END)"
    parts = "named_struct('digits', rtrim('0', ltrim('0', m.digits)), 'point', m.point + m.power - (length(m.digits) - length(ltrim('0', m.digits))))"
    mantissa = "substring_index(s, 'E', 1)"
    split = f"named_struct('digits', replace({mantissa}, '.', ''), 'point', length(substring_index({mantissa}, '.', 1)), 'power', if(contains(s, 'E'), CAST(substring_index(s, 'E', -1) AS INT), 0))"
    plain = let(f"CAST(abs({x}) AS STRING)", "s", let(split, "m", let(parts, "d", written)))
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN abs({x}) = double('Infinity') THEN if({x} > 0, 'Infinity', '-Infinity') ELSE {plain} END"


def scalar(value: str) -> str:
    """``struct<kind, text, number>``: text of a JSON text, number or flag, number of a JSON number."""
    # A cast that fails is slow, so each is only tried where it can succeed.
    read = f"named_struct('kind', k, 'text', if(k IN ('STRING', 'NUMBER', 'BOOLEAN'), try_variant_get({value}, '$', 'string'), null), 'number', if(k = 'NUMBER', try_variant_get({value}, '$', 'double'), null))"
    told = f"named_struct('kind', p.kind, 'text', CASE WHEN p.kind != 'NUMBER' OR p.text RLIKE r'{_PLAIN}' THEN p.text ELSE {number_text('p.number')} END, 'number', p.number)"
    return let(let(kind(value), "k", read), "p", told)


def any_text(value: str) -> str:
    """Any value as a text that joins arrays by commas, as a cast to text does there; objects have no text of their own."""
    flat = "CASE WHEN f.kind IN ('VOID', 'MISSING') THEN '' WHEN f.kind = 'OBJECT' THEN '[object Object]' ELSE f.text END"
    inner = f"""array_join(transform({listed(value)}, e -> coalesce(regexp_replace(if({listed('e')} IS NOT NULL, to_json(e), null), r'[\\[\\]"]', ''), {let(scalar('e'), 'f', flat)})), ',')"""
    return f"coalesce({inner}, {let(scalar(value), 'f', flat)})"


def _pair(ok: str, value: str) -> str:
    return f"named_struct('ok', {ok}, 'value', {value})"


def _fits(s: str) -> str:
    return f"({s}.kind IN ('MISSING', 'VOID', 'STRING') OR coalesce(abs({s}.number) < double('Infinity'), false))"


def verbatim(s: str) -> str:
    """Texts and finite numbers, as text. This and the readers below take a ``scalar``."""
    return _pair(_fits(s), f"if({s}.kind IN ('STRING', 'NUMBER'), {s}.text, null)")


def verbatim_filled(s: str) -> str:
    return _pair(_fits(s), f"if({s}.kind IN ('STRING', 'NUMBER'), {s}.text, '')")


def soft_text(s: str) -> str:
    return _pair(_fits(s), f"if({s}.kind IN ('STRING', 'NUMBER'), trim({s}.text), null)")


def required(s: str) -> str:
    """A text that is "" where it is missing, so that its item can still be reviewed."""
    return _pair(_fits(s), f"if({s}.kind IN ('STRING', 'NUMBER'), trim({s}.text), '')")


def _finite(text: str) -> str:
    return let(f"try_cast(nullif({text}, '') AS DOUBLE)", "x", "if(abs(x) < double('Infinity'), x, null)")


def leading_int(text: str) -> str:
    """The whole number that digits and dashes of a text begin with, as a double; null if there is none."""
    return _finite(f"regexp_extract(regexp_replace({text}, '[^0-9-]', ''), '^-?[0-9]+', 0)")


def leading_number(text: str) -> str:
    """The number a text begins with; null if it begins with none or with one of no finite size."""
    return _finite(f"regexp_extract(ltrim({text}), '^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?', 0)")


def soft_int(s: str) -> str:
    """Finite numbers as they are, and the digits of texts; ``3-4`` is 3."""
    return _pair(_fits(s), f"CASE {s}.kind WHEN 'NUMBER' THEN {s}.number WHEN 'STRING' THEN {leading_int(f'{s}.text')} END")


def soft_number(s: str) -> str:
    """Finite numbers, and those that texts begin with."""
    return _pair(_fits(s), f"CASE {s}.kind WHEN 'NUMBER' THEN {s}.number WHEN 'STRING' THEN {leading_number(f'{s}.text')} END")


def soft_flag(s: str) -> str:
    """Flags and texts; true are the flag and the text true alone."""
    return _pair(f"({s}.kind IN ('MISSING', 'VOID', 'STRING', 'BOOLEAN'))", f"coalesce({s}.kind IN ('STRING', 'BOOLEAN') AND {s}.text = 'true', false)")


def soft_numbers(value: str) -> str:
    """An array of anything as numbers: what is none, or of no finite size, is 0. Only arrays conform. This and the next take a variant."""
    x = f"if({kind('n')} = 'NUMBER', try_variant_get(n, '$', 'double'), {leading_number(any_text('n'))})"
    return _pair(f"({absent(value)} OR {listed(value)} IS NOT NULL)", f"transform({elements(value)}, n -> {let(x, 'y', "if(abs(y) < double('Infinity'), y, 0D)")})")


def soft_texts(value: str) -> str:
    """An array of anything as texts. Only arrays conform."""
    return _pair(f"({absent(value)} OR {listed(value)} IS NOT NULL)", f"transform({elements(value)}, n -> {any_text('n')})")


#: What readers make of a field of an object in which all values are texts, nulls or plain numbers: (x, whether it is a text) to (ok, value).
_AT_ONCE: dict[Reader, Callable[[str, str], tuple[str, str]]] = {
    verbatim: lambda x, _: ("", x),
    verbatim_filled: lambda x, _: ("", f"coalesce({x}, '')"),
    soft_text: lambda x, _: ("", f"trim({x})"),
    required: lambda x, _: ("", f"coalesce(trim({x}), '')"),
    soft_int: lambda x, text: ("", f"CASE WHEN {x} IS NULL THEN null WHEN {text} THEN {leading_int(x)} ELSE CAST({x} AS DOUBLE) END"),
    soft_number: lambda x, text: ("", f"CASE WHEN {x} IS NULL THEN null WHEN {text} THEN {leading_number(x)} ELSE CAST({x} AS DOUBLE) END"),
    soft_flag: lambda x, text: (f"({x} IS NULL OR {text})", f"coalesce({x} = 'true' AND {text}, false)"),
}


def record(value: str, scalars: dict[str, Reader], others: dict[str, Reader] | None = None) -> str:
    """``struct<ok, value>`` of an object: it conforms if it is one and all its fields do.

    Readers of ``scalars`` take a scalar, those of ``others`` the field's variant. Where the object's schema shows
    nothing but texts, nulls and plain numbers, all fields are taken at once; a whole number of over 15 digits then keeps them all.
    """
    others = others or {}
    names = [*scalars, *others]
    apart = f"transform(array({', '.join(member('v', n) for n in scalars)}), w -> {scalar('w')})"
    read = ", ".join([*(f"'{n}', {f(f'get(a, {i})')}" for i, (n, f) in enumerate(scalars.items())), *(f"'{n}', {f(member('v', n))}" for n, f in others.items())])
    whole = _pair(" AND ".join(f"q.{n}.ok" for n in names), "named_struct(" + ", ".join(f"'{n}', q.{n}.value" for n in names) + ")")
    found = f"if(startswith(t, 'OBJECT'), {let(let(apart, 'a', f'named_struct({read})'), 'q', whole)}, null)"
    if not others and all(f in _AT_ONCE for f in scalars.values()):
        pairs = {n: _AT_ONCE[f](f"r.{n}", f"t RLIKE '(?:<|, ){n}: STRING'") for n, f in scalars.items()}
        fine = " AND ".join(ok for ok, _ in pairs.values() if ok) or "true"
        shape = ",".join(f"{n}:string" for n in scalars)
        flat = let(f"try_variant_get(v, '$', 'struct<{shape}>')", "r", _pair(fine, "named_struct(" + ", ".join(f"'{n}', {x}" for n, (_, x) in pairs.items()) + ")"))
        found = f"if(t RLIKE r'{_FLAT}', {flat}, {found})"
    return let(value, "v", let("schema_of_variant(v)", "t", found))


def records(value: str, scalars: dict[str, Reader], others: dict[str, Reader] | None = None) -> str:
    """The conforming objects of an array, each judged alone; the others go."""
    return f"transform(filter(transform({elements(value)}, o -> {record('o', scalars, others)}), g -> g.ok), g -> g.value)"


def canonical(value: str) -> str:
    """Compact JSON with keys sorted at every depth and numbers written in one way; nulls are kept.

    A variant holds its keys sorted, so only numbers need rewriting. A number of no finite size comes out as the text Infinity.
    """
    number = let("CAST(t AS DOUBLE)", "x", number_text("x"))
    return f"array_join(transform(regexp_extract_all(to_json({value}), r'{_TOKENS}', 0), t -> if(t RLIKE '^-?[0-9]', {number}, t)), '')"


def fingerprint(value: str) -> str:
    """The first 32 digits of the SHA-256 of a value's canonical JSON."""
    return f"left(sha2(CAST({canonical(value)} AS BINARY), 256), 32)"
