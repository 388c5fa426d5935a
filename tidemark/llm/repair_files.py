"""Token ids in files compressed by Re-Pair grammars, decodable document by document.

A shard holds the ids of some documents in ascending key order. Frequent pairs of neighbouring ids
are replaced by nonterminals, round after round; the shard keeps its rules, the expansion length of
every symbol and, per document, where its symbols begin and how many ids they stand for. Any
document, or any range of its ids, is decoded from those alone. No pair reaches across documents.

A task writes a shard under a temporary name and renames it when it is whole; what is committed is
the manifest, a checkpointed table with a row per shard. A task that runs again writes the same
bytes under the same name, so a lost executor leaves nothing behind but temporary files.

File: ``MAGIC``, length of the header (uint32), header (JSON), then little-endian arrays: rules
(uint32 pairs), expansion lengths of the rules (uint32), document keys (int64), first symbol and
first id of each document and the end of the last (uint64), symbols (uint16 or uint32).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, input_tasks, range_shard, single, text_of
from tidemark.llm.tokens import encoder
from tidemark.session import cut_lineage

MAGIC = b"RPIDS\x01\x00\x00"
#: Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 2_000_000
#: Rounds of replacement, new nonterminals of a round, and how often a pair must occur.
ROUNDS, RULES_A_ROUND, LEAST = 3, 4_000, 24
TABLE_BITS = 17
MIX = np.uint64(0x9E3779B97F4A7C15)

MANIFEST = "path string, part int, seq int, n_docs long, n_ids long, n_symbols long, n_rules long, n_bytes long"


class Grammar:
    """Rules of one shard. Symbol ``base + k`` stands for the pair ``rules[k]``."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.base, self.rules, self.lengths = base, rules, lengths
        self._flat: np.ndarray | None = None

    def expansion(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' ids one after another, and where each begins; a rule uses earlier rules only."""
        at = np.cumsum(self.lengths) - self.lengths
        if self._flat is None:
            flat = np.zeros(int(self.lengths.sum()), np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                to = int(at[k])
                for s in (a, b):
                    if s < self.base:
                        flat[to] = s
                        to += 1
                    else:
                        n = int(self.lengths[s - self.base])
                        flat[to : to + n] = flat[at[s - self.base] : at[s - self.base] + n]
                        to += n
            self._flat = flat
        return self._flat, at

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.base
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        size = self.sizes(symbols)
        flat, at = self.expansion()
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        pool = np.concatenate([flat, symbols.astype(np.uint32)])  # ids stand for themselves
        begin = np.where(symbols >= self.base, 0, len(flat) + np.arange(len(symbols)))
        rule = symbols >= self.base
        begin[rule] = at[symbols[rule] - self.base]
        return pool[np.repeat(begin - end + size, size) + np.arange(total)]


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND, least: int = LEAST):
    """(symbols, ends of the documents in symbols, grammar) of documents' ids; ``ends`` in ids."""
    base = int(ids.max()) + 1 if len(ids) else 1
    seq = ids.astype(np.uint64)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    made = 0
    for _ in range(rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1] << np.uint64(32)) | seq[1:]
        inside = ~last[:-1]
        order = np.sort(keys[inside])
        if not len(order):
            break
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        counts = np.diff(np.append(starts, len(order)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        best = often[np.lexsort((order[starts[often]], -counts[often]))][:rules_a_round]
        chosen = order[starts[best]]
        spot = ((chosen * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        _, first = np.unique(spot, return_index=True)  # two pairs at one spot: the more frequent stays
        first = np.sort(first)
        chosen, spot = chosen[first], spot[first]
        table = np.full(1 << TABLE_BITS, np.iinfo(np.uint64).max, np.uint64)
        number = np.zeros(1 << TABLE_BITS, np.uint64)
        table[spot] = chosen
        number[spot] = np.arange(len(chosen), dtype=np.uint64) + np.uint64(base + made)
        here = ((keys * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        hit = np.flatnonzero((table[here] == keys) & inside)
        run = np.concatenate([[True], np.diff(hit) != 1])  # overlapping pairs: every other one
        head = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
        seq[hit] = number[here[hit]]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        pairs = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
        known = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        size = np.ones(pairs.shape, np.int64)
        size[pairs >= base] = known[pairs[pairs >= base] - base]
        rules.append(pairs)
        lengths.append(size.sum(1))
        made += len(chosen)
    grammar = Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.concatenate(lengths) if lengths else np.zeros(0, np.int64))
    # A document without ids ends where the one before it does.
    full = np.flatnonzero(last) + 1
    with_ids = np.diff(np.concatenate([[0], ends])) > 0
    out = np.concatenate([[0], full])[np.cumsum(with_ids)] if len(ends) else np.zeros(0, np.int64)
    return seq.astype(np.uint32), out.astype(np.int64), grammar


def shard_bytes(keys: np.ndarray, known: np.ndarray, ids: np.ndarray, ends: np.ndarray, **how) -> tuple[bytes, dict]:
    symbols, symbol_ends, grammar = compress(ids, ends, **how)
    wide = grammar.base + len(grammar.rules) > 1 << 16
    header = {
        "n_docs": len(keys), "n_ids": len(ids), "n_symbols": len(symbols), "n_rules": len(grammar.rules),
        "base": grammar.base, "symbol_bytes": 4 if wide else 2, "null_keys": np.flatnonzero(~known).tolist(),
    }
    head = json.dumps(header, sort_keys=True).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    parts = [
        MAGIC, np.uint32(len(head)).tobytes(), head,
        grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u4").tobytes(), keys.astype("<i8").tobytes(),
        np.concatenate([[0], symbol_ends]).astype("<u8").tobytes(), np.concatenate([[0], ends]).astype("<u8").tobytes(),
        symbols.astype("<u4" if wide else "<u2").tobytes(),
    ]
    return b"".join(parts), header


class Shard:
    """A shard read back: rules and document tables in memory, symbols as they are in the file."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        n = int(np.frombuffer(data, "<u4", 1, len(MAGIC))[0])
        at = len(MAGIC) + 4
        self.header = h = json.loads(data[at : at + n])
        at += n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        rules = take("<u4", 2 * h["n_rules"]).reshape(-1, 2).astype(np.int64)
        self.grammar = Grammar(h["base"], rules, take("<u4", h["n_rules"]).astype(np.int64))
        self.keys = take("<i8", h["n_docs"])
        self.symbol_at = take("<u8", h["n_docs"] + 1).astype(np.int64)
        self.id_at = take("<u8", h["n_docs"] + 1).astype(np.int64)
        self.symbols = take(f"<u{h['symbol_bytes']}", h["n_symbols"])
        self.null_keys = set(h["null_keys"])

    def ids(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the document in place ``k``, or those from ``first`` up to ``last``.

        Expansion lengths say which symbols cover the range; only those are expanded.
        """
        symbols = self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]].astype(np.int64)
        size = int(self.id_at[k + 1] - self.id_at[k])
        last = size if last is None else min(last, size)
        if first == 0 and last == size:
            return self.grammar.decode(symbols)
        if first >= last:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(self.grammar.sizes(symbols))
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.grammar.decode(symbols[a:b])[first - skipped : last - skipped]


def open_shard(uri: str) -> Shard:
    store, path = file_system(uri)
    with store.open_input_stream(path) as f:
        return Shard(f.read())


def _written(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, plain_case: bool, end_id: int, how: dict) -> Iterator[pa.RecordBatch]:
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    store, root = file_system(folder)
    made: list[tuple] = []
    keys: list[np.ndarray] = []
    known: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not keys:
            return
        ends = np.cumsum(np.concatenate(counts))
        data, header = shard_bytes(np.concatenate(keys), np.concatenate(known), np.concatenate(ids), ends, **how)
        name = f"{root}/shard-{part:06d}-{len(made):04d}.rpids"
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as f:
            f.write(data)
        store.move(draft, name)
        made.append((f"{folder}/{name.rsplit('/', 1)[1]}", part, len(made), header["n_docs"], header["n_ids"], header["n_symbols"], header["n_rules"], len(data)))
        for x in (keys, known, ids, counts):
            x.clear()
        held = 0

    pieces = encoder(tokenizer, plain_case)
    for batch in batches:
        key = single(batch, "key")
        value, there = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), key.is_valid().to_numpy(zero_copy_only=False)
        row = 0
        for found, n in pieces.encode(single(batch, "text")):
            closed = np.insert(found, np.cumsum(n), end_id).astype(np.uint32)  # the end id of each text
            n, taken, at = n + 1, 0, 0
            while taken < len(n):
                fits = int(np.searchsorted(np.cumsum(n[taken:]), SHARD_IDS - held, "right"))
                if fits == 0 and held:
                    flush()
                    continue
                fits = max(fits, 1)
                size = int(n[taken : taken + fits].sum())
                keys.append(value[row : row + fits])
                known.append(there[row : row + fits])
                ids.append(closed[at : at + size])
                counts.append(n[taken : taken + fits])
                row, taken, at, held = row + fits, taken + fits, at + size, held + size
    flush()
    kinds = [pa.string(), pa.int32(), pa.int32()] + [pa.int64()] * 5
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    yield pa.record_batch([pa.array([m[i] for m in made], kinds[i]) for i in range(len(names))], names=names)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", plain_case: bool = False, end_id: int = 0, **how) -> DataFrame:
    """Writes the ids of every text into ``folder`` in ascending key order; returns the manifest.

    Null texts are empty: their ids are the end id alone. Repeated keys stay next to each other,
    null keys come first. An empty table writes no shard and returns an empty manifest. The manifest
    row of a shard says which part it belongs to (``part``, ``seq``: the order of the ids), its
    documents, ids, symbols, rules and bytes.
    """
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    tasks = input_tasks(rows)
    laid = rows.withColumn("__shard", range_shard(rows.select("key"), "key", tasks)).repartitionById(tasks, F.col("__shard")) if tasks > 1 else rows.coalesce(1)
    laid = laid.sortWithinPartitions("key", "text").select("key", "text")
    return cut_lineage(laid.mapInArrow(lambda it: _written(it, folder, tokenizer, plain_case, end_id, how), MANIFEST))


def _with_base(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each shard; a row per shard, so one task does."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["base"], open_shard(row["path"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, shard in _each_shard(batches):
        docs = len(shard.keys)
        ids = shard.grammar.decode(shard.symbols).astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.id_at[:-1].tolist(), shard.id_at[1:].tolist())]
        keys = pa.array(shard.keys.astype(np.int64), mask=np.isin(np.arange(docs), list(shard.null_keys)))
        columns = [keys, pa.array(base + shard.id_at[:-1]), pa.array(np.diff(shard.id_at)), pa.array(crc, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, shard in _each_shard(batches):
        for k in range(len(shard.keys)):
            key = None if k in shard.null_keys else int(shard.keys[k])
            columns = [pa.array([key], pa.int64()), pa.array([base + int(shard.id_at[k])]), pa.array([shard.ids(k).tolist()], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "start", "ids"])


def _read(manifest: DataFrame, reader, schema: str) -> DataFrame:
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.rdd.getNumPartitions())
    return _with_base(manifest).select("path", "base").repartition(tasks, "path").mapInArrow(reader, schema)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document in the shards of a manifest."""
    return _read(manifest, _documents, "doc_id long, start long, ids array<long>")


def digest_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the shards' ids."""
    return _read(manifest, _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
