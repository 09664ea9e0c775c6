"""Training-order token output: packed sequences, a keyed permutation, fixed-stride shards.

1. Each task tokenises its documents in stored order, with one end token after each, and
   cuts the stream into sequences of `length` ids; only a task's last one is padded.
   The sequences wait compressed in the shared folder.
2. Sequence counts of the tasks are summed up, so every sequence has a place in 0..N-1.
3. A Feistel network keyed by the seed permutes 0..2^b-1 for the least even b that covers
   N; walking its cycles until a value falls below N makes it a permutation of 0..N-1.
   The result is the sequence's slot in training order.
4. Range partitions of slots, whole shards each, are sorted and written: shard s holds the
   slots from s * rows on, every sequence takes length * item size bytes (2, or 4 for
   vocabularies over 65,536), so slot i is read at byte (i % rows) * stride of shard i // rows.  A shard is written under another name
   and moved, and one that is there in full is left alone: a lost executor's task or a
   second run writes only what is missing.  The slots are dealt in rounds of whole shards,
   so that one round's shuffle at a time lies on disk.

The order depends on the stored documents, how they are split into tasks, and the seed.

meta.json holds a digest of all sequences: a folder with shards of other documents is refused.

Defined results: null and empty texts are an end token alone; equal rows are separate
documents; no documents give no sequences and no shards.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, scratch, stored

#: Sequences in one stored block.
BLOCK = 64


def default_tokenizer() -> dict:
    """A public byte-level BPE vocabulary: path, pattern and the free id that ends a document."""
    import public_tokenizers

    return {"path": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN, "end": 50256}


_loaded: dict = {}


def _encoder(tokenizer: dict):
    """The tokenizer of a ranks file that every executor can read; loaded once in each process."""
    key = tokenizer["path"]
    if key not in _loaded:
        import tiktoken

        with open(key, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _loaded[key] = tiktoken.Encoding("own", pat_str=tokenizer["pattern"], mergeable_ranks=ranks, special_tokens={})
    return _loaded[key].encode_ordinary


def item_type(tokenizer: dict) -> str:
    """The numpy type of an id: two bytes if every id of the vocabulary fits."""
    with open(tokenizer["path"], "rb") as file:
        most = max((int(line.split()[1]) for line in file if line.strip()), default=0)
    return "<u2" if max(most, tokenizer["end"]) < 1 << 16 else "<u4"


def sequences(docs: DataFrame, length: int, tokenizer: dict, dtype: str = "<u2") -> DataFrame:
    """(part, first, n, used, blob, docs): blocks of up to BLOCK sequences; docs: (doc_id, at, n) by token place in the block."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("doc_id", pa.int64() if id_type == "bigint" else pa.string()), ("at", pa.int64()), ("n", pa.int64())]))

    def each(batches):
        encode, end, part = _encoder(tokenizer), tokenizer["end"], TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=3)
        buffer, spans, held, first = [], [], 0, 0
        room = BLOCK * length

        def block(tokens, spans, first):
            n = -(-len(tokens) // length)
            padded = np.full(n * length, end, dtype=dtype)
            padded[: len(tokens)] = tokens
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([squeeze.compress(padded.tobytes())], pa.binary()), pa.array([spans], spans_type)],
                ["part", "first", "n", "used", "blob", "docs"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], dtype=dtype)
                doc_id = doc_id.as_py() if id_type == "bigint" or not doc_id.is_valid else str(doc_id.as_py())
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, room - held)
                    buffer.append(ids[at : at + take])
                    spans.append({"doc_id": doc_id, "at": held, "n": take})
                    held, at = held + take, at + take
                    if held == room:
                        yield block(np.concatenate(buffer), spans, first)
                        buffer, spans, held, first = [], [], 0, first + BLOCK
        if held:
            yield block(np.concatenate(buffer), spans, first)

    id_type = "bigint" if id_type == "bigint" else "string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, f"part int, first bigint, n int, used bigint, blob binary, docs array<struct<doc_id:{id_type},at:bigint,n:bigint>>")


def permute(places: np.ndarray, total: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..total-1: a balanced Feistel network with cycle-walking."""
    half = max(1, -(-max(1, total - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = places.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(rows: DataFrame, folder: str, stride: int, per_shard: int, total: int) -> DataFrame:
    """Write sorted whole shards; returns a row for each sequence."""

    def each(batches):
        store, root = _open(folder)
        expand = zstandard.ZstdDecompressor()
        shard, file, name = -1, None, ""

        def close():
            if file is not None:
                file.close()
                store.move(name, f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            slots, crc = batch.column(0).to_numpy(), []
            for slot, blob in zip(slots.tolist(), batch.column(1), strict=True):
                data = expand.decompress(blob.as_py())
                crc.append(zlib.crc32(data))
                if slot // per_shard != shard:
                    close()
                    shard = slot // per_shard
                    want = min(per_shard, total - shard * per_shard) * stride
                    info = store.get_file_info(f"{root}/shard-{shard:08d}.bin")
                    name = f"{root}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                    file = None if info.type == fs.FileType.File and info.size == want else store.open_output_stream(name)
                if file is not None:
                    file.write(data)
            out = [batch.column(0), pa.array(slots // per_shard), pa.array(slots % per_shard), batch.column(2), pa.array(crc, pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out, ["slot", "shard", "row", "n_tokens", "crc32", "docs"])
        close()

    spans = rows.schema["docs"].dataType.simpleString()
    return rows.select("slot", "blob", "n_tokens", "docs").mapInArrow(each, f"slot bigint, shard bigint, row bigint, n_tokens int, crc32 bigint, docs {spans}")


def write_shards(docs: DataFrame, folder: str, length: int = 2048, per_shard: int = 2048, seed: int = 7, tokenizer: dict | None = None, rounds: int = 2) -> DataFrame:
    """Writes the shards and meta.json into folder (a URI that all executors share).

    Returns slot, shard, row, n_tokens, crc32 (of the stored bytes) and docs ((doc_id, at, n) by
    token place in the sequence) of every sequence.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    dtype = item_type(tokenizer)
    stride = length * np.dtype(dtype).itemsize
    blocks = stored(sequences(docs, length, tokenizer, dtype), "tokens")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("c"), F.bit_xor(F.xxhash64("part", "first", "n", "used", "blob")).alias("mark"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(parts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), "c", "mark").coalesce(1), "offsets")
    total, digest = (int(x or 0) for x in offsets.agg(F.sum("c"), F.bit_xor("mark")).first())
    shards = -(-total // per_shard)
    meta = {"sequences": total, "length": length, "per_shard": per_shard, "dtype": dtype, "seed": seed, "end": tokenizer["end"], "digest": f"{digest & (2**64 - 1):016x}"}
    store, root = _open(folder)
    store.create_dir(root)
    if store.get_file_info(f"{root}/meta.json").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/meta.json") as f:
            if json.loads(f.read()) != meta:
                raise ValueError(f"{folder} holds shards of another run")
    else:
        with store.open_output_stream(f"{root}/meta.json") as f:
            f.write(json.dumps(meta).encode())
    id_type = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    spans = f"array<struct<doc_id:{id_type},at:int,n:int>>"
    spans_type = pa.list_(pa.struct([("doc_id", pa.int64() if id_type == "bigint" else pa.string()), ("at", pa.int32()), ("n", pa.int32())]))

    def each_of(low: int, high: int):
        def each(batches):
            expand, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
            for batch in batches:
                for offset, first, n, used, blob, held in zip(*[batch.column(i) for i in range(6)], strict=True):
                    n, used = n.as_py(), used.as_py()
                    slots = permute(offset.as_py() + first.as_py() + np.arange(n), total, seed)
                    mine = np.flatnonzero((slots >= low) & (slots < high))
                    if not len(mine):
                        continue
                    data = memoryview(expand.decompress(blob.as_py()))
                    per = [[] for _ in range(n)]
                    for s in held.as_py():
                        at, left = s["at"], s["n"]
                        while left:
                            i, k = at // length, min(left, length - at % length)
                            per[i].append({"doc_id": s["doc_id"], "at": at % length, "n": k})
                            at, left = at + k, left - k
                    out = [squeeze.compress(data[i * stride : (i + 1) * stride]) for i in mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[mine]), pa.array(out, pa.binary()), pa.array(np.clip(used - mine * length, 0, length).astype(np.int32)), pa.array([per[i] for i in mine], spans_type)],
                        ["slot", "blob", "n_tokens", "docs"],
                    )

        return each

    written = []
    rounds = max(1, min(rounds, shards))
    for r in range(rounds):
        low, high = shards * r // rounds, shards * (r + 1) // rounds
        if low == high:
            continue
        rows = blocks.join(offsets.select("part", "offset"), "part").select("offset", "first", "n", "used", "blob", "docs")
        rows = rows.mapInArrow(each_of(low * per_shard, high * per_shard), f"slot bigint, blob binary, n_tokens int, docs {spans}")
        # Slots are uniform, so equal ranges of shards are equal work; no sampling is needed.
        tasks = min(high - low, max(spark.sparkContext.defaultParallelism, (high - low) * per_shard * stride >> 26))
        place = F.floor((F.floor(F.col("slot") / per_shard) - low) * tasks / (high - low)).cast("int")
        rows = rows.repartitionById(tasks, place).sortWithinPartitions("slot")
        written.append(stored(_write(rows, folder, stride, per_shard, total), "manifest"))
    out = written[0] if written else spark.createDataFrame([], f"slot bigint, shard bigint, row bigint, n_tokens int, crc32 bigint, docs {spans}")
    for more in written[1:]:
        out = out.unionByName(more)
    return out


def read_sequences(folder: str, first: int = 0, count: int | None = None):
    """Yields the sequences from slot `first` on, as arrays of ids: a reader resumes at any slot by one seek."""
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/meta.json") as f:
        meta = json.loads(f.read())
    last = meta["sequences"] if count is None else min(meta["sequences"], first + count)
    stride = meta["length"] * np.dtype(meta["dtype"]).itemsize
    while first < last:
        shard, row = divmod(first, meta["per_shard"])
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(row * stride)
            for _ in range(row, min(meta["per_shard"], row + last - first)):
                yield np.frombuffer(f.read(stride), dtype=meta["dtype"])
                first += 1


def shards_in_scratch(docs: DataFrame, **parameters) -> DataFrame:
    """write_shards into a new scratch folder."""
    return write_shards(docs, scratch(docs.sparkSession, "shards"), **parameters)


