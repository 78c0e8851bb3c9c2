"""Deeply nested records to flat, linked tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.payload import loads
from strandline.operators.structural import COMMA, OPEN_ARRAY, StructuralIndex

#: Fields whose elements become rows, with the member that names an element's kind.
FIELDS = {"content": "type", "inserted": "role", "messages": "role", "messageSeqs": None}
#: Bytes of JSON that are indexed at once; a single longer document is indexed alone.
CHUNK_BYTES = 4 << 20

ELEMENT_SCHEMA = "record_id bigint, path string, field string, position bigint, parent_path string, kind string, value string"


def elements_of(documents: list[bytes], fields: dict[str, str | None] = FIELDS, values: bool = True) -> tuple[np.ndarray, dict[str, list]]:
    """(document number, columns) of every element of the given fields in those documents that are valid JSON."""
    ix = StructuralIndex(documents)
    names = list(fields)
    kinds = sorted({k for k in fields.values() if k})
    named = ix.colons_named(names + [k for k in kinds if k not in names])
    hit = np.flatnonzero((named >= 0) & (named < len(names)))
    field_colon, field_name = ix.colons[hit], named[hit]
    start = ix.value_start(field_colon)
    first = ix.buf[start]
    is_array = first == 91
    single = np.flatnonzero(~is_array & (first != ord("n")))
    # slots: the token before a value, its field, its position in the array (-1: no array)
    of_array = np.full(len(ix.pos), -1)
    of_array[field_colon[is_array] + 1] = np.flatnonzero(is_array)
    commas = np.flatnonzero(ix.kind == COMMA)
    commas = commas[of_array[ix.owner[commas]] >= 0]
    heads = field_colon[is_array] + 1
    heads = heads[ix.buf[ix.value_start(heads)] != 93]
    slot = np.concatenate((field_colon[single], heads, commas))
    which = np.concatenate((single, of_array[heads], of_array[ix.owner[commas]])).astype(np.int64)
    position = np.concatenate((np.zeros(len(single), np.int64), np.zeros(len(heads), np.int64), ix.ordinal[commas]))
    at = ix.value_start(slot)
    byte = ix.buf[at]
    keep = byte != ord("n")
    order = np.argsort(slot[keep], kind="stable")
    slot, which, position, at, byte = (x[keep][order] for x in (slot, which, position, at, byte))
    # kinds
    member: dict[str, np.ndarray] = {}
    for kind in kinds:
        token = np.full(len(ix.pos), -1)
        colons = ix.colons[named == (names + [k for k in kinds if k not in names]).index(kind)]
        token[ix.owner[colons]] = colons
        member[kind] = token
    kind_text = np.full(len(slot), "", object)
    number = np.isin(byte, np.frombuffer(b"-0123456789", np.uint8))
    for n, name in enumerate(names):
        own = np.flatnonzero(field_name[which] == n)
        label = fields[name]
        if label is None:
            own = own[number[own]]
            kind_text[own] = ix.texts(at[own], ix.value_stop(at[own], slot[own])).to_pylist()
            continue
        if name == "content":
            kind_text[own[byte[own] == 34]] = "text"
        objects = own[byte[own] == 123]
        colons = member[label][slot[objects] + 1]
        objects, colons = objects[colons >= 0], colons[colons >= 0]
        begin = ix.value_start(colons)
        lead = ix.buf[begin]
        plain = lead == 34
        kind_text[objects[plain]] = ix.strings(begin[plain], colons[plain])
        other = ~plain & (lead != ord("n"))
        kind_text[objects[other]] = ix.texts(begin[other], ix.value_stop(begin[other], colons[other])).to_pylist()
    # paths of the containers that hold fields, parents first; a field's single value stands at position 0
    holder = ix.owner[field_colon]
    element_at = np.full(len(ix.pos), -1)
    boxed = np.flatnonzero((byte == 123) | (byte == 91))
    element_at[slot[boxed] + 1] = boxed
    sole = np.zeros(len(ix.pos), bool)
    sole[field_colon[single] + 1] = True
    path: dict[int, str] = {}
    near: dict[int, int] = {}
    for c in np.unique(holder).tolist():
        steps, at_c, above_c = [], c, -1
        while at_c not in path and ix.level[at_c] > 1:
            before = at_c - 1
            if above_c < 0:
                above_c = int(element_at[at_c])
            if ix.kind[before] in (COMMA, OPEN_ARRAY):
                steps.append(f"[{ix.ordinal[before]}]")
            else:
                steps.append(f".{ix.key(before)}[0]" if sole[at_c] else f".{ix.key(before)}")
            at_c = int(ix.owner[before])
        base = path.get(at_c, "")
        while not base and steps:  # no dot where nothing stands before it
            step = steps.pop()
            base = step[1:] if step[0] == "." else step
        steps.reverse()
        path[c] = base + "".join(steps)
        near[c] = above_c if above_c >= 0 else near.get(at_c, -1)
    base = [f"{path[h]}.{names[n]}" if path[h] else names[n] for h, n in zip(holder.tolist(), field_name.tolist())]
    full = [f"{base[w]}[{p}]" for w, p in zip(which.tolist(), position.tolist())]
    columns: dict[str, list] = {"path": full, "kind": kind_text.tolist()}
    if values:
        above = [near[int(h)] for h in holder[which]]
        columns |= {
            "field": [names[n] for n in field_name[which].tolist()],
            "position": position.tolist(),
            "parent_path": [None if a < 0 else full[a] for a in above],
            "value": ix.texts(at, ix.value_stop(at, slot)).cast(pa.string()) if len(at) else [],
        }
    return ix.document(slot), columns


def _body(text: str | None) -> str | None:
    """The document to index: a payload that is a JSON string holds it; None for what can't be an object or array."""
    lead = text.lstrip(" \t\n\r")[:1] if text else ""
    if lead == '"':
        try:
            text = loads(text)
        except ValueError:
            return None
        lead = text.lstrip(" \t\n\r")[:1]
    return text if lead in ("{", "[") and lead else None


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, out, size = [], [], 0
    for i, text in enumerate(texts):
        body = _body(text)
        if body is None:
            continue
        data = body.encode("utf-8", "replace")
        if out and size + len(data) > CHUNK_BYTES:
            yield rows, out
            rows, out, size = [], [], 0
        rows.append(i)
        out.append(data)
        size += len(data)
    if out:
        yield rows, out


def flatten_elements(df: DataFrame, id_column: str, json_column: str, fields: dict[str, str | None] = FIELDS, values: bool = True) -> DataFrame:
    """One row for each non-null element of the named fields, at any depth, of every JSON document in df.

    record_id and path identify an element, parent_path names the nearest enclosing element of the same record (null at the
    top), position its place in its array (0 for a value that is no array, which is its own only element). kind follows
    `fields`: the named member, 'text' for a plain string in content, the number itself where no member is named, else ''.
    Rows whose document is null, empty or not JSON give no rows; a document that is a JSON string is parsed once more.
    Repeated rows and null ids are kept as they are; other columns of df are ignored, whatever their names; an empty df gives
    an empty table. A member given twice counts as two.

    The work is one map over the batches of the scan: no shuffle, memory bounded by CHUNK_BYTES or the longest document.
    """
    columns = ["path", "field", "position", "parent_path", "kind", "value"] if values else ["path", "kind"]
    kinds = {"path": pa.string(), "field": pa.string(), "position": pa.int64(), "parent_path": pa.string(), "kind": pa.string(), "value": pa.string()}
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, documents in _chunks(batch.column(1).to_pylist()):
                which, data = elements_of(documents, fields, values)
                take = pa.array(np.asarray(rows, np.int64)[which])
                yield pa.RecordBatch.from_arrays([ids.take(take), *(x if isinstance(x := data[c], pa.Array) else pa.array(x, kinds[c]) for c in columns)], ["record_id", *columns])

    schema = f"record_id {id_type}, " + ", ".join(f"{c} {'bigint' if c == 'position' else 'string'}" for c in columns)
    return df.select(F.col(id_column).alias("a"), F.col(json_column).cast("string").alias("b")).mapInArrow(run, schema)


#: Typed columns of each field's table: where a member lies in an element and what it is.
MEMBERS = {
    "content": {
        "text": ("$.text", "string"), "call_id": ("$.toolCallId", "string"), "id": ("$.id", "string"), "name": ("$.name", "string"), "arguments": ("$.arguments", "string"),
        "is_error": ("$.isError", "boolean"), "media_type": ("$.mediaType", "string"), "ref": ("$.ref", "string"), "file": ("$.path", "string"),
    },
    "inserted": {"id": ("$.id", "string"), "source_kind": ("$.source.kind", "string")},
    "messages": {"id": ("$.id", "string")},
    "messageSeqs": {"seq": ("$", "bigint")},
}


def nested_tables(df: DataFrame, id_column: str, json_column: str, members: dict[str, dict[str, tuple[str, str]]] = MEMBERS) -> dict[str, DataFrame]:
    """The flat tables of a nested log: one for each field, linked by (record_id, parent_path) to the element above.

    Each has record_id, path, parent_path, parent_field, position and kind, and the typed columns of `members` (null where an
    element has no such member or one of another type); a plain string in content is its own text. What a typed column leaves
    out is in value, the element's JSON text.
    """
    everything = flatten_elements(df, id_column, json_column)
    out = {}
    for name in FIELDS:
        rows = everything.where(F.col("field") == name).withColumn("_v", F.try_parse_json("value"))
        typed = []
        for column, (at, kind) in members.get(name, {}).items():
            typed.append(F.try_variant_get("_v", at, kind).alias(column))
            if (name, column) == ("content", "text"):
                typed[-1] = F.when(F.substring("value", 1, 1) == '"', F.try_variant_get("_v", "$", "string")).otherwise(F.try_variant_get("_v", at, kind)).alias(column)
        above = F.nullif(F.regexp_extract("parent_path", r"([^.\[\]]+)(\[[0-9]+\])$", 1), F.lit("")).alias("parent_field")
        out[name] = rows.select("record_id", "path", "parent_path", above, "position", "kind", *typed, "value")
    return out
