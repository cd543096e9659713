"""Replay by scripts: units whose turns are alike make the same records but for the unit's name, the ids made of it, and the
digests that it enters.

A task runs the kernel once for each script that it meets again, on a unit whose name is a mark. What comes out is a template:
its rows as Arrow columns in which every text that depends on the unit is a place in a list of texts, and a program that makes
this list, digests among them, for one unit. Scripts that come once, units of many turns, units without a name, and texts
that hold the mark go through the kernel itself, so whatever the turns are, the records are the kernel's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pathloom.functions import canon

MARK = "\ue000"
UNIT = f"{MARK}u{MARK}"
#: Columns of records whose texts may depend on the unit.
VARYING = ("unit_id", "queue_id", "digest")
#: Turns up to which a unit is replayed by its script.
LONGEST = 256
#: Different turns, their characters, and scripts that a task remembers before it forgets them all.
TURNS, CHARACTERS, SCRIPTS = 50_000, 16_000_000, 20_000
#: Records to a batch of output.
BATCH = 8000
_PARTS = re.compile(f'"{MARK}b([0-9]+){MARK}"|{MARK}(u|d[0-9]+){MARK}')


def _format(text: str) -> tuple[str, list[int]]:
    """A text with marks as a format, and the places of what goes into it: 0 the unit, 1 + 2k the k-th digest, 2 + 2k its text's size."""
    places: list[int] = []

    def place(m: re.Match) -> str:
        places.append(2 + 2 * int(m[1]) if m[1] else 0 if m[2] == "u" else 1 + 2 * int(m[2][1:]))
        return "%s"

    return _PARTS.sub(place, text.replace("%", "%%")), places


def _picker(places: list[int]) -> Callable[[list], tuple]:
    return itemgetter(*places) if len(places) > 1 else lambda values: tuple(values[p] for p in places)


class Symbols:
    """Digests and artifacts as ``canon`` makes them, of texts with marks: a digest that depends on the unit is a mark itself."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, list[int]]] = []

    def _seal(self, text: str) -> tuple[str, object]:
        if MARK not in text:
            return canon.raw_digest(text), len(text.encode())
        self.steps.append(_format(text))
        n = len(self.steps) - 1
        return f"{MARK}d{n}{MARK}", f"{MARK}b{n}{MARK}"

    def digest(self, value: object) -> str:
        return self._seal(canon.canonical_json(value))[0]

    def artifact(self, contract_id: str, payload: object) -> dict:
        made = canon.artifact(contract_id, payload)
        digest, size = self._seal(canon.canonical_json(payload))
        return made | {"digest": digest, "bytes": size}


def _kind(kind: pa.DataType, varies: bool = False) -> pa.DataType:
    """A column's type in a template, where places stand for texts that vary."""
    if pa.types.is_list(kind):
        return pa.list_(_kind(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _kind(f.type, f.name in VARYING)) for f in kind])
    return pa.int32() if varies else kind


class Template:
    """The rows of a script, and what makes the texts that vary for one unit."""

    def __init__(self, rows: list[dict], steps: list[tuple[str, list[int]]], schema: pa.Schema) -> None:
        known: dict[str, int] = {}

        def placed(value, kind: pa.DataType, name: str = ""):
            if value is None:
                return None
            if pa.types.is_list(kind):
                return [placed(v, kind.value_type) for v in value]
            if pa.types.is_struct(kind):
                return {f.name: placed(value[f.name], f.type, f.name) for f in kind}
            if name in VARYING:
                return known.setdefault(value, len(known))
            if isinstance(value, str) and MARK in value:
                raise ValueError(f"{name} depends on the unit")
            return value

        row = pa.struct(list(schema))
        self.rows = pa.RecordBatch.from_pylist([placed(r, row) for r in rows], pa.schema([pa.field(f.name, _kind(f.type, f.name in VARYING)) for f in schema]))
        self.n, self.texts = len(rows), len(known)
        parts = [_format(t) for t in known]
        told = any(p for _, places in parts for p in places)  # whether any digest is
        self.steps = [(text, _picker(places)) for text, places in steps] if told else []
        self.line, self.picked = "\n".join(f for f, _ in parts), _picker([p for _, ps in parts for p in ps])
        if any("\n" in t for t in known):
            raise ValueError("a text of more than a line")

    def of(self, unit_id: str) -> list[str]:
        """The texts that vary, for one unit."""
        if not self.texts:
            return []
        quoted = canon.canonical_json(unit_id)[1:-1] if self.steps else unit_id
        values: list = [quoted]
        for text, picked in self.steps:
            made = (text % picked(values)).encode("utf-8", "surrogatepass")
            values += hashlib.sha256(made).hexdigest(), len(made)
        if "\n" in unit_id:
            values[0] = MARK
            return [t.replace(MARK, unit_id) for t in (self.line % self.picked(values)).split("\n")]
        values[0] = unit_id
        return (self.line % self.picked(values)).split("\n")


def _filled(column: pa.Array, kind: pa.DataType, base: np.ndarray, texts: pa.Array, varies: bool = False) -> pa.Array:
    """A template's column taken for units, with the texts that vary: ``base`` tells where a row's unit has its own in ``texts``."""
    if pa.types.is_list(kind):
        offsets = column.offsets.to_numpy()
        values = _filled(column.values.slice(offsets[0], offsets[-1] - offsets[0]), kind.value_type, np.repeat(base, np.diff(offsets)), texts)
        offsets = pa.array(offsets - offsets[0])
        return pa.ListArray.from_arrays(offsets, values, type=kind, mask=column.is_null() if column.null_count else None)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_filled(c, f.type, base, texts, f.name in VARYING) for c, f in zip(column.flatten(), kind, strict=True)], fields=list(kind))
    return texts.take(pc.add(column.cast(pa.int64()), pa.array(base))) if varies else column


def _rows_of(units: list[tuple[str, Template]], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of units, from their templates."""
    order: dict[int, int] = {}
    used = [t for _, t in units if id(t) not in order and order.setdefault(id(t), len(order)) >= 0]
    which = np.array([order[id(t)] for _, t in units])
    n = np.array([t.n for t in used])
    lengths, starts = n[which], (np.cumsum(n) - n)[which]
    index = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    sizes = np.array([t.texts for t in used])[which]
    base = np.repeat(np.cumsum(sizes) - sizes, lengths)
    texts = pa.array([x for unit_id, t in units for x in t.of(unit_id)], pa.string())
    taken = pa.concat_batches([t.rows for t in used]).take(pa.array(index))
    return pa.RecordBatch.from_arrays([_filled(c, f.type, base, texts, f.name in VARYING) for c, f in zip(taken.columns, schema, strict=True)], schema=schema)


class Scripts:
    """What a task knows of turns and scripts."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.turns: list[dict] = []
        self.characters = 0
        self.made: dict[bytes, Template | None] = {}

    def full(self) -> bool:
        return len(self.turns) > TURNS or self.characters > CHARACTERS or len(self.made) > SCRIPTS

    def id(self, values: tuple) -> int:
        if (found := self.ids.get(values)) is None:
            found = self.ids[values] = len(self.turns)
            self.turns.append(dict(zip(self.columns, values, strict=True)))
            self.characters += sum(len(v) for v in values if isinstance(v, str))
        return found

    def numbered(self, batch: pa.RecordBatch) -> np.ndarray:
        """The number of each row's turn; equal turns have one number."""
        code, lists = np.zeros(batch.num_rows, np.int64), []
        for c in self.columns:
            found = pc.dictionary_encode(batch.column(batch.schema.get_field_index(c)), null_encoding="encode")
            values, places = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
            lists.append((values, places))
            if len(values) > 1:
                code = np.unique(code * len(values) + places, return_inverse=True)[1]
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        return np.array([self.id(tuple(values[places[k]] for values, places in lists)) for k in first], np.int32)[which]


def run(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], schema: pa.Schema, begin, marked: bool) -> Iterator[pa.RecordBatch]:
    """The records of units whose sorted turns stream by. ``begin(unit_id, seals)`` makes a unit's fold: ``take`` gives the
    records of a turn (None: of its admission) and ``end`` those at its end. ``marked``: the graph itself holds the mark."""
    scripts = Scripts(columns)
    told: list[dict] = []  # by the kernel
    units: list[tuple[str, Template]] = []  # by their scripts
    rows = 0

    def folded(fold, turns: Iterable[dict | None]) -> list[dict]:
        return [r for t in turns for r in fold.take(t)]

    def template(key: bytes, numbers: np.ndarray) -> Template | None:
        turns = [scripts.turns[k] for k in numbers]
        if marked or any(MARK in v for t in turns for v in t.values() if isinstance(v, str)):
            return None
        fold = begin(UNIT, symbols := Symbols())
        try:
            made = Template([*folded(fold, (None, *turns)), *fold.end()], symbols.steps, schema)
        except ValueError:  # what varies elsewhere than templates can tell
            return None
        scripts.made[key] = made
        return made

    def whole(unit_id: str | None, numbers: np.ndarray) -> None:
        nonlocal rows
        key = numbers.tobytes()
        found = scripts.made.get(key)
        if found is None and key in scripts.made and unit_id is not None:
            found = template(key, numbers)
        if found is not None and unit_id is not None:
            units.append((unit_id, found))
            rows += found.n
            return
        scripts.made.setdefault(key, None)
        fold = begin(unit_id, canon)
        told.extend((*folded(fold, (None, *(scripts.turns[k] for k in numbers))), *fold.end()))

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal rows
        while len(told) >= max(least, 1):
            yield pa.RecordBatch.from_pylist(told[:BATCH], schema)
            del told[:BATCH]
        if rows >= max(least, 1):
            yield _rows_of(units, schema)
            units.clear()
            rows = 0

    held, name, long = None, None, None  # the turns of the unit that the last batch ended in, or its fold once there are many
    for batch in batches:
        if not batch.num_rows:
            continue
        if scripts.full():
            kept = [tuple(scripts.turns[k][c] for c in columns) for k in held] if held is not None else []
            scripts.forget()
            held = np.array([scripts.id(v) for v in kept], np.int32) if held is not None else None
        numbers = scripts.numbered(batch)
        found = pc.dictionary_encode(batch.column(batch.schema.get_field_index("unit_id")), null_encoding="encode")
        names, at = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])).tolist()
        for low, high in zip(starts, starts[1:]):
            unit_id, own = names[at[low]], numbers[low:high]
            if (held is not None or long) and name != unit_id:
                if long:
                    told.extend(long.end())
                else:
                    whole(name, held)
                held, long = None, None
                yield from ready(BATCH)
            name = unit_id
            if not long:
                held = own if held is None else np.concatenate((held, own))
                if len(held) <= LONGEST:
                    continue
                long, own, held = begin(unit_id, canon), held, None
                told.extend(long.take(None))
            for k in own:
                told.extend(long.take(scripts.turns[k]))
                yield from ready(BATCH)
    if long:
        told.extend(long.end())
    elif held is not None:
        whole(name, held)
    yield from ready(0)
