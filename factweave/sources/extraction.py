"""Tolerant schema-on-read of model output: scalars are coerced, malformed items dropped one by one.

JSON is read with its types, so that a number given for a text is taken and an object is not. A chunk whose identity or
valuation is malformed doesn't conform as a whole; an item of an array that doesn't costs itself alone. A text is parsed once, in batches
of Arrow: readers written as expressions run interpreted over nested values, at a multiple of the time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import CODES, clean_code
from . import reading, typed

# Field names of a chunk's JSON.
IDENTITY_FIELDS = ("companyName", "ticker", "exchange", "isin", "sector", "industry", "currency", "researchHouse", "analystName", "analystTitle", "publishedDate", "reportType", "accountingBasis")
VALUATION_FIELDS = ("rating", "previousRating", "cmp", "cmpDate", "baseTarget", "bullTarget", "bearTarget", "previousTarget", "horizon", "valuationBasis", "appliedMultiple")

#: Kinds of narrative items.
NARRATIVES = ("risk", "catalyst", "thesis", "section")

# The first contract, one document at a time.
LEGACY_TEXTS = ("title", "company", "reportDate", "recommendation", "cmp", "baseCaseTarget", "bullCaseTarget", "valuationMethodology")
CHART_TYPES = ("line", "bar", "comparison")
#: Longest document that the first contract takes.
LEGACY_CHARS = 800_000
#: Documents whose parsed objects are held together.
_AT_ONCE = 500


#: What readers give; the rest give texts.
_GIVES: dict[reading.Reader, pa.DataType] = {reading.soft_int: pa.float64(), reading.soft_number: pa.float64(), reading.soft_flag: pa.bool_(), reading.soft_numbers: pa.list_(pa.float64()), reading.soft_texts: pa.list_(pa.string())}
_DDL = {pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.int32(): "int"}


def _ddl(of: pa.DataType) -> str:
    """A type of Arrow as Spark writes it."""
    if pa.types.is_list(of):
        return f"array<{_ddl(of.value_type)}>"
    if pa.types.is_struct(of):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in of) + ">"
    return _DDL[of]


def _shape(taken: reading.Fields) -> pa.DataType:
    return pa.struct([(to, _GIVES.get(f, pa.string())) for to, _, f in taken])


def _read(payload: Column, of: pa.DataType, read: Callable[[str | None], dict[str, Any]]) -> Column:
    """What ``read`` makes of each text; null where it finds the whole malformed."""

    def one(text: str | None) -> dict[str, Any] | None:
        try:
            return read(text)
        except reading.Malformed:
            return None

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], of)

    return _whole(batch, of)(payload)


def _whole(batch: Callable[[pa.Array], pa.Array], of: pa.DataType) -> Callable[[Column], Column]:
    # Not to be pushed below a filter or into one, where it would run a second time.
    return F.arrow_udf(batch, _ddl(of)).asNondeterministic()


def _readers(*fields: str) -> reading.Fields:
    return reading.fields({f: reading.soft_int if f.endswith("Page") else reading.required if f.endswith("Quote") else reading.soft_text for f in fields})


# Where each kind of item stands in a chunk, and the fields that fill its places.
PLACES = {
    "metric": ("metrics", {"title": "label", "body": "rawValue", "period": "period", "code": "classificationCode", "category": "category"}),
    "risk": ("risks", {"title": "name", "body": "explanation"}),
    "catalyst": ("catalysts", {"title": "name", "body": "explanation", "period": "expectedPeriod", "code": "direction"}),
    "thesis": ("thesisPoints", {"title": "title", "body": "explanation"}),
    "section": ("sections", {"title": "heading", "body": "summary"}),
}
_RECORDS = {"identity": _readers(*IDENTITY_FIELDS, "identityQuote", "identityPage"), "valuation": _readers(*VALUATION_FIELDS, "valuationQuote", "valuationPage")}
#: For each place of an item its field and reader.
_TAKEN = {kind: [(place, field, reading.required if place in ("title", "body", "quote") else reading.soft_int if place == "page" else reading.soft_text) for place, field in (places | {"quote": "sourceQuote", "page": "sourcePage"}).items()] for kind, (_, places) in PLACES.items()}
_ITEM = pa.struct([("kind", pa.string()), ("item_idx", pa.int32()), *((p, pa.string()) for p in ("title", "body", "period", "code", "category", "quote")), ("page", pa.float64())])
_BODY = pa.struct([("given", pa.struct([(name, pa.int32()) for name, _ in PLACES.values()])), ("items", pa.list_(_ITEM))])
_CHUNK = pa.struct([("body", _BODY), *((kind, _shape(readers)) for kind, readers in _RECORDS.items())])
_OPENED = re.compile(r"```(?:json)?\s*", re.IGNORECASE)


def _fenced(text: str | None) -> dict[str, Any]:
    bare = (text or "").strip()
    opened = _OPENED.match(bare)
    bare = bare[opened.end() :] if opened else bare
    whole = reading.parsed(bare[:-3].rstrip() if bare.endswith("```") else bare)
    if type(whole) is not dict:
        raise reading.Malformed
    return whole


def _chunk(text: str | None) -> dict[str, Any]:
    whole = _fenced(text)
    found = {kind: None if whole.get(kind) is None else reading.record(whole[kind], readers) for kind, readers in _RECORDS.items()}
    items: list[dict[str, Any]] = []
    given = {}
    for kind, (name, _) in PLACES.items():
        each = whole.get(name)
        given[name] = len(each) if type(each) is list else 0
        for i, r in enumerate(reading.records(each, _TAKEN[kind]) if each else ()):
            r["kind"], r["item_idx"] = kind, i
            items.append(r)
    return found | {"body": {"given": given, "items": items}}


def read_chunks(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """Chunks with ``identity`` and ``valuation`` (null if absent) and ``body``, in place of the payload.

    ``body`` has the ``items`` that conform and how many each array had ``given``. ``conforms`` tells whether the payload is one object and neither
    record in it is malformed; else all three are null.
    """
    kept = [c for c in chunks.columns if c != payload]
    rows = chunks.select(*kept, _read(F.col(payload), _CHUNK, _chunk).alias("_c"))
    return rows.select(*kept, F.col("_c").isNotNull().alias("conforms"), "_c.body", "_c.identity", "_c.valuation")


def read_items(read: DataFrame, kinds: tuple[str, ...] = tuple(PLACES)) -> DataFrame:
    """A row for each conforming item of chunks as ``read_chunks`` gives them: kind, item_idx (among those kept), title, body, period, code, category, quote and page.

    A metric's code outside the set (AI among them) is U; for a catalyst ``code`` is its direction.
    """
    keys = [c for c in read.columns if c not in ("conforms", "identity", "valuation", "body")]
    rows = read.select(*keys, F.explode("body.items").alias("i")).select(*keys, "i.*")
    return _with_codes(rows if set(kinds) == set(PLACES) else rows.where(F.col("kind").isin(*kinds)))


def _with_codes(rows: DataFrame) -> DataFrame:
    codes = tuple(c for c in CODES if c != "AI")
    code = F.when(F.col("kind") == "metric", F.coalesce(clean_code(F.col("code"), codes), F.lit("U"))).otherwise(F.col("code"))
    return rows.withColumns({"code": code, "page": page(F.col("page"))})


#: Kinds of rows that ``read_rows`` gives.
KINDS = (*_RECORDS, *PLACES)
#: Chunks whose parsed objects are held together.
_CHUNKS_AT_ONCE = 1_000
_OF_RECORD = {kind: [f for f in readers if f[0] not in (f"{kind}Quote", f"{kind}Page")] for kind, readers in _RECORDS.items()}
_ROW = pa.struct([*_ITEM, *((kind, _shape(readers)) for kind, readers in _OF_RECORD.items())])


def read_rows(chunks: DataFrame, payload: str = "payload", kinds: Collection[str] = KINDS) -> DataFrame:
    """A flat row for each conforming item, and for the identity and the valuation, of the chunks that conform: what ``read_chunks`` and ``read_items`` give, read by columns.

    A record's row has its fields in the struct of its name, which is null in all others, and its own quote and page; its item_idx is 0, its title and body are
    empty. Rows of kinds that aren't wanted aren't made, but a malformed record costs its chunk all the same.
    """
    keys = [c for c in chunks.columns if c != payload]
    schema = StructType([*chunks.select(*keys).schema, *StructType.fromDDL(",".join(f"{f.name} {_ddl(f.type)}" for f in _ROW))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNKS_AT_ONCE):
                part = batch.slice(start, _CHUNKS_AT_ONCE)
                for owner, columns in _rows(part.column(payload).to_pylist(), kinds):
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(owner) for k in keys), *columns], [*keys, *(f.name for f in _ROW)])

    return _with_codes(chunks.mapInArrow(rows, schema))


def _rows(texts: list[str | None], kinds: Collection[str]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """For each kind the places of the chunks its rows come from, and the columns of ``_ROW``."""
    wholes: list[dict[str, Any]] = []
    places: list[int] = []
    for i, text in enumerate(texts):
        try:
            wholes.append(_fenced(text))
            places.append(i)
        except reading.Malformed:
            continue
    owner, good = np.array(places, np.int64), np.ones(len(wholes), bool)

    def out(kind: str, at: np.ndarray, idx: np.ndarray, columns: dict[str, pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
        columns |= {"kind": pa.array([kind] * len(at), pa.string()), "item_idx": pa.array(idx, pa.int32())}
        return pa.array(owner[at]), [columns[f.name] if f.name in columns else pa.nulls(len(at), f.type) for f in _ROW]

    records = {}
    for kind, readers in _RECORDS.items():
        at = np.array([i for i, w in enumerate(wholes) if w.get(kind) is not None], np.int64)
        each = [wholes[i][kind] for i in at]
        found, fine = _columns([v if type(v) is dict else {} for v in each], readers, [to for to, _, _ in readers])
        good[at[~(fine & np.array([type(v) is dict for v in each], bool))]] = False
        records[kind] = (at, found)
    for kind, (at, found) in records.items():
        if kind in kinds and (kept := good[at]).any():
            found, at = found.filter(pa.array(kept)), at[kept]
            blank = pa.array([""] * len(at), pa.string())
            own = pa.StructArray.from_arrays([found.field(to) for to, _, _ in _OF_RECORD[kind]], [to for to, _, _ in _OF_RECORD[kind]])
            yield out(kind, at, np.zeros(len(at), np.int32), {"title": blank, "body": blank, "quote": found.field(f"{kind}Quote"), "page": found.field(f"{kind}Page"), kind: own})
    for kind, (name, _) in PLACES.items():
        if kind not in kinds:
            continue
        listed = [(i, v) for i, w in enumerate(wholes) if good[i] and type(v := w.get(name)) is list]
        each = [x for _, v in listed for x in v]
        dicts = np.array([type(x) is dict for x in each], bool)
        found, fine = _columns([x if type(x) is dict else {} for x in each], _TAKEN[kind], [to for to, _, _ in _TAKEN[kind]])
        at, kept = np.repeat(np.array([i for i, _ in listed], np.int64), [len(v) for _, v in listed]), fine & dicts
        if kept.any():
            found, at = found if kept.all() else found.filter(pa.array(kept)), at[kept]
            n = np.arange(len(at))
            idx = n - np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1]), n, 0))
            yield out(kind, at, idx, {f.name: found.field(f.name) for f in found.type})


def page(number: Column) -> Column:
    """A cited page as a number of a page; a part of a page is none."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 2147483648.0), number).cast("int")


def soft_bool(value: Column) -> Column:
    return F.coalesce(value.cast("string") == "true", F.lit(False))


def legacy_numbers(values: str) -> Column:
    """An array of texts (SQL) as numbers: nulls, unreadable ones and those of no finite size become 0, and a missing array an empty one."""
    return F.expr(f"transform(coalesce({values}, CAST(array() AS ARRAY<STRING>)), n -> coalesce({typed.leading_number('n')}, 0D))")


def _bar_unless_known(v: Any) -> str:
    """A chart's type; whatever it is else, it is a bar chart."""
    return v if type(v) is str and v in CHART_TYPES else "bar"


_SERIES = reading.fields({"name": reading.verbatim_filled, "data": reading.soft_numbers})


def _series(v: Any) -> list[dict[str, Any]]:
    return reading.records(v, _SERIES)


_GIVES[_series] = pa.list_(_shape(_SERIES))
_T, _E = reading.verbatim, reading.verbatim_filled
#: The first contract's own texts, and readers of the fields of its arrays.
_OWN = reading.fields(dict.fromkeys(LEGACY_TEXTS, _T))
_LEGACY: dict[str, reading.Fields] = {
    "metrics": reading.fields({"name": _E, "value": _E, "unit": _T, "currency": _T, "period": _T, "isHistorical": reading.soft_flag, "category": _E, "sourceExcerpt": _E, "page": reading.soft_number}),
    "sections": reading.fields({"title": _E, "summary": _E, "evidence": _E, "pageReferences": reading.soft_numbers}),
    "risks": reading.fields({"risk": _E, "explanation": _E, "evidence": _E}),
    "charts": reading.fields({"type": _bar_unless_known, "title": _E, "labels": reading.soft_texts, "series": _series}),
}


def _column(values: list[Any], read: reading.Reader) -> tuple[pa.Array, list[int]]:
    """What a reader makes of the values of a field, and the places of malformed ones."""
    of = _GIVES.get(read, pa.string())
    if read in (_T, _E, reading.soft_text, reading.required):
        try:
            found = pa.array(values, of)  # refuses what is neither a text nor null
            found = found if read in (_T, _E) else pc.utf8_trim(found, " ")
            return found.fill_null("") if read in (_E, reading.required) else found, []
        except (pa.ArrowException, TypeError, UnicodeError):
            pass
    elif of == pa.float64() and set(map(type, values)) <= {float, type(None)}:
        found = pa.array(values, of)
        if not pc.any(pc.is_inf(found)).as_py():
            return found, []
    out, bad = [], []
    for i, v in enumerate(values):
        try:
            out.append(read(v))
        except reading.Malformed:
            out.append(None)
            bad.append(i)
    return pa.array(out, of), bad


def _columns(objects: list[dict[str, Any]], taken: reading.Fields, kept: Collection[str]) -> tuple[pa.StructArray, np.ndarray]:
    """The ``kept`` fields of many objects, and which objects conform; all fields are judged."""
    good, columns, present = np.ones(len(objects), bool), {}, set().union(*objects)
    for to, name, read in taken:
        if name in present:
            column, bad = _column([o.get(name) for o in objects], read)
            good[bad] = False
        elif to in kept:
            column = pa.array([read(None)] * len(objects), _GIVES.get(read, pa.string()))
        if to in kept:
            columns[to] = column
    return pa.StructArray.from_arrays(list(columns.values()), list(columns)), good


def _document(text: str | None) -> dict[str, Any] | None:
    text = text or ""
    if len(text) > LEGACY_CHARS:
        return None
    try:
        whole = reading.parsed(text[text.find("{") : text.rfind("}") + 1])
    except reading.Malformed:
        return None
    return whole if type(whole) is dict else None


def _documents(texts: pa.Array, kept: dict[str, Collection[str]]) -> pa.Array:
    """A batch of payloads by columns: a reader is called for each value only where a column isn't all texts."""
    wholes = [_document(t) for t in texts.to_pylist()]
    objects = [w or {} for w in wholes]
    own, good = _columns(objects, _OWN, kept["own"])
    good &= np.array([w is not None for w in wholes], bool)
    fields = {"own": own}
    for name, readers in _LEGACY.items():
        each = [[x for x in found if type(x) is dict] if type(found := o.get(name)) is list else [] for o in objects]
        items, fine = _columns([x for xs in each for x in xs], readers, kept[name])
        owner = np.repeat(np.arange(len(each)), [len(xs) for xs in each])
        ends = np.cumsum(np.bincount(owner[fine], minlength=len(each)))
        fields[name] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), items if fine.all() else items.filter(pa.array(fine)))
    return pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=pa.array(~good))


def read_legacy(rows: DataFrame, payload: str = "payload", fields: dict[str, Collection[str]] | None = None) -> DataFrame:
    """The first contract's own texts and the arrays metrics, sections, risks and charts, in place of the payload.

    The object goes from the first brace to the last. ``conforms`` is false, and the rest null, beyond ``LEGACY_CHARS``
    characters, without an object, or if one of its own texts is malformed. Charts of an unknown type are bar charts.
    ``fields`` names what is wanted of the document (``own``) or an array, where that isn't everything; what isn't given out is judged all the same.
    """
    every = {"own": _OWN, **_LEGACY}
    kept = {name: {to for to, _, _ in readers} & set((fields or {}).get(name, [to for to, _, _ in readers])) for name, readers in every.items()}
    shapes = {name: _shape([r for r in readers if r[0] in kept[name]]) for name, readers in every.items()}
    of = pa.struct([(name, shape if name == "own" else pa.list_(shape)) for name, shape in shapes.items()])

    def batch(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_documents(texts.slice(i, _AT_ONCE), kept) for i in range(0, max(1, len(texts)), _AT_ONCE)])

    others = [c for c in rows.columns if c != payload]
    read = rows.select(*others, _whole(batch, of)(F.col(payload)).alias("_d"))
    return read.select(*others, F.col("_d").isNotNull().alias("conforms"), "_d.own.*", *(f"_d.{name}" for name in _LEGACY))
