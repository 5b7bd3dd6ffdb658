"""Which keys of a document occur in another document too, for any number of documents.

Keys are 64-bit hashes. A map task numbers its rows and settles a chunk of them on its own: of a key
that several rows of the chunk have, one entry goes on, so a key of a third of all rows reaches
the shuffle once a chunk. Entries go to key ranges as packed arrays, and each range answers only
the entries whose key came from two chunks. Answers return to blocks of rows, again packed. A block is
part of one chunk, so that it is bounded by keys as well as by rows (a single row is never cut).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievemark.llm.memory import give_back
from sievemark.llm.wordhash import U, pack_sorted, planes, unpack_sorted, unplanes

#: Keys that a map task settles at once; a block has 2 to the power of BLOCK_BITS rows.
CHUNK_KEYS, BLOCK_BITS = 1_000_000, 11
#: Blocks that a chunk has fewer than; ranges that a chunk is cut into at once; bytes of entries that are cut again at once.
MOST_BLOCKS, MOST_RANGES, REDEALT_BYTES = 1024, 1 << 14, 32 << 20
_WIRE = pa.schema([("slot", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("meta", pa.binary())])
_WIRE_DDL = "slot long, block long, kind int, a binary, b binary, meta binary"
ENTRY, ANSWER, ROWS, HOT = 0, 1, 2, 3

#: A batch to (distinct keys of all its rows one after another, how many each row has, what to keep of the rows).
Extract = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]]


def _ipc(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def by_block(metas: list[pa.RecordBatch], row: int, slots: int) -> Iterator[tuple]:
    """What is kept of the rows numbered row, row + 1 ..., cut where blocks end."""
    for m in metas:
        done = 0
        while done < m.num_rows:
            block = row >> BLOCK_BITS
            n = min(m.num_rows - done, ((block + 1) << BLOCK_BITS) - row)
            yield (slots + block, block, ROWS, planes(np.arange(row, row + n)), b"", _ipc(m.slice(done, n)))
            done += n
            row += n


def next_block(row: int) -> int:
    """The first row number of the next block. A chunk's rows begin a new one, so that a block is no larger than a chunk."""
    return -(-row >> BLOCK_BITS) << BLOCK_BITS


def _chunk(keys: list, counts: list, metas: list, base: int, slots: int, width: np.uint64) -> Iterator[tuple]:
    """Rows for the wire from the rows numbered base, base + 1 ..."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    owner = np.repeat(np.arange(base, base + len(n)), n)
    order = np.argsort(k, kind="stable")
    k, owner = k[order], owner[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(k)))
    shared = np.repeat(size > 1, size)
    yield from by_block(metas, base, slots)
    yield from _answers(owner[shared], k[shared], slots)
    blocks = (next_block(base + len(n)) - base) >> BLOCK_BITS
    who = np.where(size > 1, -1 - ((base >> BLOCK_BITS) * MOST_BLOCKS + blocks), owner[at])
    yield from _entries(k[at], who, size, width)


def _entries(k: np.ndarray, who: np.ndarray, rows: np.ndarray, width: np.uint64) -> Iterator[tuple]:
    """Sorted keys by ranges. who: the one row that has the key, or below 0 the blocks whose rows know already that it repeats."""
    slot = (k // width).astype(np.int64)
    cut = np.flatnonzero(np.diff(slot)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(k)], strict=True):
        if hi > lo:
            yield (int(slot[lo]), 0, ENTRY, pack_sorted(k[lo:hi]), planes(who[lo:hi]), planes(rows[lo:hi].astype(np.int32)))


def _unpacked(entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, and who and rows."""
    k = np.concatenate([unpack_sorted(x.as_py()) for x in entries["a"]])
    who = np.concatenate([unplanes(x.as_py(), np.int64) for x in entries["b"]])
    rows = np.concatenate([unplanes(x.as_py(), np.int32) for x in entries["meta"]])
    order = np.argsort(k, kind="stable")
    return k[order], who[order], rows[order]


def _redeal(width: np.uint64):
    """Cuts the entries of a wide range, which come together, into narrow ranges, many chunks' at once."""

    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                t = pa.Table.from_batches([batch])
                own = pa.array(t["kind"].to_numpy() == ENTRY)
                for r in t.filter(pa.compute.invert(own)).to_pylist():
                    yield tuple(r[f.name] for f in _WIRE)
                held.append(t.filter(own))
                size += held[-1].nbytes
                if size > REDEALT_BYTES:
                    yield from _entries(*_unpacked(pa.concat_tables(held)), width)
                    held, size = [], 0
            if size:
                yield from _entries(*_unpacked(pa.concat_tables(held)), width)

        return _batches(rows())

    return redeal


def _answers(owner: np.ndarray, keys: np.ndarray, slots: int, kind: int = ANSWER) -> Iterator[tuple]:
    """Found keys by blocks of rows."""
    order = np.argsort(owner, kind="stable")
    owner, keys = owner[order], keys[order]
    block = owner >> BLOCK_BITS
    cut = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(owner)], strict=True):
        if hi > lo:
            yield (slots + int(block[lo]), int(block[lo]), kind, planes(owner[lo:hi]), keys[lo:hi].tobytes(), b"")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + len(r[4]) + len(r[5])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WIRE, strict=True)], schema=_WIRE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WIRE, strict=True)], schema=_WIRE)


def repeated_keys(df: DataFrame, extract: Extract, finish: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, slots: int, hot: int = 0) -> DataFrame:
    """finish gets what extract kept of a block's rows, and for the keys that another row has too, the places of their rows in it (ascending) and the keys.

    slots: key ranges; each is read by one task, which holds all its entries. Beyond MOST_RANGES of them chunks are cut
    into wide ranges, and those again into narrow ones, so that no wire row is of a few keys only.
    hot: keys are even, and one that so many rows have comes back with its lowest bit set.
    Rows must come in the same order when a lost task runs again, as those of a file scan do.
    """
    wide = -(-slots // MOST_RANGES)
    slots = -(-slots // wide) * wide
    width = np.uint64((1 << 64) // slots + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            base = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
            keys, counts, metas, held, n = [], [], [], 0, 0
            for batch in batches:
                for k, own, meta in extract(batch):
                    keys.append(k)
                    counts.append(own)
                    metas.append(meta)
                    held += len(k)
                    n += len(own)
                    if held >= CHUNK_KEYS or n >= CHUNK_KEYS // 2:
                        yield from _chunk(keys, counts, metas, base, slots, np.uint64(min(int(width) * wide, (1 << 64) - 1)))
                        base = next_block(base + n)
                        keys, counts, metas, held, n = [], [], [], 0, 0
                        give_back()
            if counts:
                yield from _chunk(keys, counts, metas, base, slots, np.uint64(min(int(width) * wide, (1 << 64) - 1)))

        return _batches(rows())

    def meet(table: pa.Table) -> pa.Table:
        give_back()  # the last group's
        kind = table["kind"].to_numpy()
        passed = table.filter(pa.array(kind != ENTRY)).to_batches()
        entries = table.filter(pa.array(kind == ENTRY))
        out = []
        if entries.num_rows:
            k, who, rows = _unpacked(entries)
            first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
            size = np.diff(np.append(first, len(k)))
            many = np.repeat(np.add.reduceat(rows, first, dtype=np.int64) >= hot if hot else np.zeros(len(first), bool), size)
            told = np.repeat(size > 1, size) & (who >= 0)
            out = list(_batches(_answers(who[told], k[told] | many[told].astype(U), slots)))
            if len(known := np.flatnonzero(many & (who < 0))):
                code = -1 - who[known]
                n = code % MOST_BLOCKS
                block = np.repeat(code // MOST_BLOCKS, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out += list(_batches(_answers(block << BLOCK_BITS, np.repeat(k[known], n), slots, HOT)))
        return pa.Table.from_batches([*passed, *out], schema=_WIRE)

    def gather(table: pa.Table) -> pa.Table:
        give_back()
        kind = table["kind"].to_pylist()
        a, b, m = table["a"], table["b"], table["meta"]
        ids, metas, owner, keys, hottest = [], [], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]
        for i, what in enumerate(kind):
            if what == ROWS:
                ids.append(unplanes(a[i].as_py(), np.int64))
                metas.append(pa.ipc.open_stream(m[i].as_py()).read_all())
            elif what == HOT:
                hottest.append(np.frombuffer(b[i].as_py(), dtype=U))
            else:
                owner.append(unplanes(a[i].as_py(), np.int64))
                keys.append(np.frombuffer(b[i].as_py(), dtype=U))
        ids, owner, keys, hottest = np.concatenate(ids), np.concatenate(owner), np.concatenate(keys), np.concatenate(hottest)
        if len(hottest):
            keys = keys | np.isin(keys, hottest).astype(U)
        rows = pa.concat_tables(metas)
        by = np.argsort(ids, kind="stable")
        rows, ids = rows.take(pa.array(by)), ids[by]
        at = np.searchsorted(ids, owner)
        order = np.lexsort((keys, at))
        at, keys = at[order], keys[order]
        if len(keys):
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
            at, keys = at[new], keys[new]
        return finish(rows, at, keys)

    wire = df.mapInArrow(spread, _WIRE_DDL)
    if wide > 1:
        wire = wire.repartition("slot").sortWithinPartitions("slot").mapInArrow(_redeal(width), _WIRE_DDL)
    met = wire.groupBy("slot").applyInArrow(meet, _WIRE_DDL)
    return met.groupBy("block").applyInArrow(gather, schema)
