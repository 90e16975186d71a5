"""Language-model scoring of documents by a sharded Elias-Fano trie of trigrams.

Style: Arrow batches with NumPy inside tasks; Spark deals, groups and joins.

p1(w) = (c(w) + 1) / (N + V + 1); p2(w | v) = (c(v w) + m2 p1) / (c(v) + m2);
p3(w | u v) = (c(u v w) + m3 p2) / (c(u v) + m3); a document starts with one start mark and ends with one
end token, and its first word has p2.  All words not seen in training share one of the V + 1 places, so p
sums to one.  The trie holds c(v w) / (c(v) + m2), m3 / (c(u v) + m3) and c(u v w) / (c(u v) + m3) as
one-byte codes, rounded down; the other terms are exact.

1. Documents are packed into chunks of about BYTES_AT_ONCE bytes of text, words as numbers into the
   chunk's list of distinct words, and stored.
2. Each chunk asks for its words, dealt by hash: a bucket adds up the counts of all chunks, numbers the
   words it knows and answers every chunk.
3. Each chunk asks for its distinct n-grams, with its training counts, dealt by their first word; words
   that hold a large share of the text by the first pair, and such pairs by all three words.  So a bucket
   never exceeds a bounded share, whatever word, pair or passage is hot, and every bucket is a whole
   subtree.  A bucket adds up the counts, builds its part of the trie in one memory map, looks every
   distinct n-gram up by successor search relative to its context, and answers every chunk in codes.
4. Answers meet their chunk, which sums the log probabilities of its documents.

Nothing of the model is broadcast or collected but two numbers per word bucket and the hot pairs, at most
twice the number of buckets.  What is dealt grows with the distinct n-grams of the chunks.  Every n-gram
counts; there is no cut-off.

Nulls and limits: a null or empty text is one end token.  A null id falls to fold 0, so it is trained on.
Equal rows are separate documents.  Without training documents p1 is 1 for all.  More than 2^32 - 3 words
raise an error.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import Store, held_fold
from penmark.llm.elias_fano import VALUES, Trie, quantise
from penmark.llm.substring_dedup import mix

FOLDS = 7
HELD_FOLD = 2
WEIGHT_2 = 300.0
WEIGHT_3 = 3.0
BYTES_AT_ONCE = 4_000_000
TOKENS_PER_BUCKET = 600_000
MAX_BUCKETS = 1 << 16
END, START, FIRST_WORD = 0, 1, 2
UNKNOWN = (1 << 32) - 1
SPACE = b" \t\n\x0b\x0c\r"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of equal significance together, compressed."""
    heads = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    data = heads + b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    heads, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, length in heads.reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").ravel())
        at += size * length
    return out


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words per text, and all words as numbers into the list of distinct ones, in order of hash."""
    stripped = [t.lower().strip(SPACE) for t in texts]
    ends = np.cumsum([0, *map(len, stripped)])
    column = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(stripped))])
    split = pc.ascii_split_whitespace(column)
    lengths = np.diff(split.offsets.to_numpy())
    flat = split.flatten()
    if not all(stripped):
        lengths[[i for i, t in enumerate(stripped) if not t]] = 0
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    order = np.argsort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words))
    return lengths, rank[coded.indices.to_numpy()], [words[i] for i in order]


CHUNK = "chunk bigint, tokens binary, words binary, counts binary, n_tokens bigint, n_docs bigint, n_train bigint"


def chunks(docs: DataFrame, store: Store) -> DataFrame:
    """Stored chunks of ``docs`` (doc_id, held_out, raw): ids, and texts as packed numbers."""
    id_field = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    schema = T.StructType([id_field, *T.StructType.fromDDL(CHUNK).fields])

    def chunk(number: int, ids: list[pa.Array], held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        lengths, index, words = distinct_words(texts)
        train = ~np.array(held, bool)
        of_train = np.repeat(train, lengths)
        counts = pack(np.bincount(index[of_train], minlength=len(words)).astype(np.uint32), np.bincount(index, minlength=len(words)).astype(np.uint32))
        tokens = pack(lengths.astype(np.uint32), train.astype(np.uint8), index)
        packed_words = pack(np.frombuffer(b"\n".join(words), np.uint8))
        flat = pa.concat_arrays(ids)
        row = [number, tokens, packed_words, counts, int(len(index) + len(texts)), len(texts), int(train.sum())]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
        columns += [pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # final once stored
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            first = 0
            raws, outs = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for i, raw in enumerate(raws):
                held.append(outs[i])
                texts.append(raw or b"")
                size += len(texts[-1]) + 20
                if size >= BYTES_AT_ONCE:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    yield chunk(number, ids, held, texts)
                    number, first = number + 1, i + 1
                    ids, held, texts, size = [], [], [], 0
            if first < len(raws):
                ids.append(batch.column(0).slice(first))
        if texts:
            yield chunk(number, ids, held, texts)

    return store.put(docs.mapInArrow(run, schema), "chunks")


ASKS = "bucket int, chunk bigint, ask binary"
ANSWERS = "bucket int, chunk bigint, answer binary"


def _rows(kind: str, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, chunk, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "chunk", kind])


def answered(asks: DataFrame, answer) -> DataFrame:
    """Asks of a bucket together: ``answer`` maps their list to one answer each, and an extra one or
    None, which goes out as chunk -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            answers, extra = answer([a for _, a in held])
            rows = [(bucket, c, a) for (c, _), a in zip(held, answers, strict=True)]
            return _rows("answer", rows + ([(bucket, -1, extra)] if extra is not None else []))

        bucket, held = None, []
        for batch in batches:
            for b, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if held:
                        yield out()
                    bucket, held = b, []
                held.append((c, a))
        if held:
            yield out()

    return asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _split_words(data: bytes) -> list[bytes]:
    raw = unpack(data)[0].tobytes()
    return raw.split(b"\n") if raw else []


def word_asks(found: DataFrame, buckets: int) -> DataFrame:
    """Words of each chunk with their counts, by ranges of their hash (the order of the chunk's list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, (train, every) = _split_words(data), unpack(counts)
                bucket = ((_word_hashes(words) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[b], cut[b + 1])
                    text = np.frombuffer(b"\n".join(words[own]), np.uint8)
                    rows.append((b, chunk, pack(text, train[own], every[own])))
                yield _rows("ask", rows)

    return found.select("chunk", "words", "counts").mapInArrow(run, ASKS)


def count_words(asks: list[bytes]) -> tuple[list[bytes], bytes]:
    """Place within the bucket by falling count, from 1 (0: not in training), and counts of every asked
    word; the extra answer holds the number of known words and of their occurrences."""
    parts = [unpack(a) for a in asks]
    words = [p[0].tobytes().split(b"\n") for p in parts]
    code = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    index = code.indices.to_numpy()
    train, every = (np.bincount(index, weights=np.concatenate([p[k] for p in parts])).astype(np.uint64) for k in (1, 2))
    number = np.zeros(len(train), np.uint32)
    number[np.argsort(train, kind="stable")[::-1]] = np.arange(1, len(train) + 1)
    number[train == 0] = 0
    cut = np.cumsum([len(ws) for ws in words])[:-1]
    answers = [pack(number[i], train[i], every[i]) for i in np.split(index, cut)]
    return answers, pack(np.array([(train > 0).sum(), train.sum()], np.uint64))


CODED = "chunk bigint, tokens binary, numbers binary"


def coded_chunks(found: DataFrame, answers: DataFrame, buckets: int, store: Store) -> DataFrame:
    """Chunks with the global number and the counts (training, all) of each of their words.  Numbers
    take turns over the buckets, so frequent words have small ones, which pack well."""
    listed = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    joined = found.select("chunk", "ids", "tokens").join(listed, "chunk", "left")
    schema = T.StructType([found.schema["ids"], *T.StructType.fromDDL(CODED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for got in batch.column(3).to_pylist():
                parts = []
                for x in sorted(got or [], key=lambda y: y["bucket"]):
                    number, train, every = unpack(x["answer"])
                    whole = (number.astype(np.int64) - 1) * buckets + x["bucket"] + FIRST_WORD
                    parts.append((np.where(number > 0, whole, UNKNOWN).astype(np.uint32), train, every))
                if not parts:
                    parts = [(np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
                out.append(pack(*(np.concatenate(x) for x in zip(*parts, strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=schema.names)

    return store.put(joined.mapInArrow(run, schema), "coded")


class Text:
    """A chunk's documents as one row of word numbers, each with a start mark and an end token."""

    def __init__(self, tokens: bytes, numbers: bytes, docs: tuple[int, int]):
        lengths, train, index = unpack(tokens)
        number, count, every = unpack(numbers)
        self.lengths, self.train = lengths.astype(np.int64), train.astype(bool)
        size = self.lengths + 2
        end = np.cumsum(size)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.words, self.counts, self.every = (np.zeros(int(size.sum()), t) for t in (np.int64, np.float64, np.float64))
        inner = np.ones(len(self.words), bool)
        inner[end - 1] = inner[end - size] = False
        self.words[end - size] = START
        self.words[end - 1] = END
        self.counts[~inner], self.every[~inner] = docs[1], docs[0]
        self.words[inner], self.counts[inner], self.every[inner] = number[index], count[index], every[index]
        self.is_token = np.ones(len(self.words), bool)
        self.is_token[end - size] = False
        known = self.words != UNKNOWN
        same = self.doc[1:] == self.doc[:-1]
        self.pair_at = np.flatnonzero(same & known[1:] & known[:-1])  # first word of each pair
        both = np.zeros(len(self.words), bool)
        both[self.pair_at] = True
        self.triple_at = np.flatnonzero(both[:-1] & both[1:])


def hot_pairs(coded: DataFrame, docs: tuple[int, int], limit: int) -> np.ndarray:
    """Pairs of frequent words that occur over ``limit`` times: rows of (u << 32 | v, all, training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Text(tokens, numbers, docs)
                hot = t.every > limit
                at = t.pair_at[hot[t.pair_at] & hot[t.pair_at + 1]]
                key, index = np.unique(t.words[at] << 32 | t.words[at + 1], return_inverse=True)
                every, train = np.bincount(index, minlength=len(key)), np.bincount(index[t.train[t.doc[at]]], minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, every, train)], names=["pair", "n", "train"])

    counted = coded.select("tokens", "numbers").mapInArrow(run, "pair bigint, n bigint, train bigint").groupBy("pair")
    rows = counted.agg(F.sum("n").alias("n"), F.sum("train").alias("train")).where(F.col("n") > limit).orderBy("pair")
    return np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 3)


class Layout:
    """Which n-grams a chunk asks of which bucket, in the order that answers come back in."""

    def __init__(self, t: Text, pairs: np.ndarray, buckets: int, limit: int):
        self.pair_key, self.pair_of = np.unique(t.words[t.pair_at] << 32 | t.words[t.pair_at + 1], return_inverse=True)
        u, v = self.pair_key >> 32, self.pair_key & UNKNOWN
        place = np.full(len(t.words), -1)
        place[t.pair_at] = self.pair_of
        triple = place[t.triple_at] << 32 | t.words[t.triple_at + 2]
        triple, self.triple_of = np.unique(triple, return_inverse=True)
        self.parent, self.last = triple >> 32, triple & UNKNOWN
        self.context = np.zeros(len(u), np.float64)
        self.context[self.pair_of] = t.counts[t.pair_at]
        hot = np.zeros(len(u), bool)
        hot[self.pair_of] = t.every[t.pair_at] > limit
        self.train_pairs = np.bincount(self.pair_of[t.train[t.doc[t.pair_at]]], minlength=len(u))
        self.train_triples = np.bincount(self.triple_of[t.train[t.doc[t.triple_at]]], minlength=len(triple))

        def bucket(*names: np.ndarray) -> np.ndarray:
            h = np.zeros(len(names[0]), np.uint64)
            for x in names:
                h = mix(h ^ mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)

        home = bucket(u, np.where(hot, v + 1, 0))
        # A hot pair's third words are dealt over as many buckets as its share asks for.
        split = np.zeros(len(u), np.int64)
        total = np.zeros(len(u), np.int64)
        if len(pairs):
            at = np.minimum(np.searchsorted(pairs[:, 0], self.pair_key), len(pairs) - 1)
            met = pairs[at, 0] == self.pair_key
            split[met] = np.minimum(buckets, 1 + pairs[at[met], 1] // max(1, limit))
            total[met] = pairs[at[met], 2]
        w_part = np.zeros(len(self.last), np.int64)
        wide = np.flatnonzero(split[self.parent] > 0)
        w_part[wide] = 1 + (mix(self.last[wide].astype(np.uint64)) % split[self.parent[wide]].astype(np.uint64)).astype(np.int64)
        triple_bucket = home[self.parent]
        triple_bucket[wide] = bucket(u[self.parent[wide]], v[self.parent[wide]] + 1, w_part[wide])
        # Guests: split pairs in the buckets of their third words, with their known total.
        guest = np.unique(np.stack([triple_bucket[wide], self.parent[wide]], axis=1), axis=0) if len(wide) else np.zeros((0, 2), np.int64)
        node_bucket = np.concatenate([home, guest[:, 0]])
        node = np.concatenate([np.arange(len(u)), guest[:, 1]])
        is_guest = np.arange(len(node)) >= len(u)
        # Pairs and triples are in order already; stable sorts keep it within a bucket.
        order = np.argsort(node, kind="stable") if len(guest) else np.arange(len(node))
        order = order[np.argsort(node_bucket[order].astype(np.uint16), kind="stable")]
        self.node, self.is_guest = node[order], is_guest[order]
        self.node_cut = np.searchsorted(node_bucket[order], np.arange(buckets + 1))
        self.triples = np.argsort(triple_bucket.astype(np.uint16), kind="stable")
        self.triple_cut = np.searchsorted(triple_bucket[self.triples], np.arange(buckets + 1))
        self.count = np.where(self.is_guest, total[self.node], self.train_pairs[self.node])

    def buckets(self) -> list[int]:
        return np.flatnonzero(np.diff(self.node_cut)).tolist()

    def ask(self, b: int) -> bytes:
        n, t = slice(self.node_cut[b], self.node_cut[b + 1]), self.triples[self.triple_cut[b] : self.triple_cut[b + 1]]
        node = self.node[n]
        key = self.pair_key[node]
        u, begin = np.unique(key >> 32, return_index=True)
        # Each triple goes below the last node of its pair (the guest, where there are two).
        below = np.searchsorted(node, self.parent[t], side="right") - 1
        times = np.bincount(below, minlength=len(node))
        columns = [u, np.diff(np.append(begin, len(key))), self.context[node[begin]], key & UNKNOWN, times, self.last[t], self.train_triples[t]]
        columns = [c.astype(np.uint32) if i != 2 else c.astype(np.uint64) for i, c in enumerate(columns)]
        return pack(*columns, self.count[n].astype(np.uint64), self.is_guest[n].astype(np.uint8))


def ngram_asks(coded: DataFrame, docs: tuple[int, int], pairs: np.ndarray, buckets: int, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tokens, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                layout = Layout(Text(tokens, numbers, docs), pairs, buckets, limit)
                yield _rows("ask", [(b, chunk, layout.ask(b)) for b in layout.buckets()])

    return coded.select("chunk", "tokens", "numbers").mapInArrow(run, ASKS)


def answer_ngrams(weight_2: float, weight_3: float):
    """Adds up the asked n-grams of a bucket, builds its trie and looks all of them up in it."""

    def answer(asks: list[bytes]) -> tuple[list[bytes], None]:
        parts = [unpack(a) for a in asks]
        nodes = [len(p[3]) for p in parts]
        u = np.concatenate([np.repeat(p[0], p[1]) for p in parts]).astype(np.uint64)
        context = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
        pair, first, which = np.unique(u << np.uint64(32) | np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
        count = np.concatenate([p[7] for p in parts]).astype(np.float64)
        guest = np.concatenate([p[8] for p in parts]).astype(bool)
        total = np.bincount(which[~guest], weights=count[~guest], minlength=len(pair))
        total[which[guest]] = count[guest]  # every chunk says the same
        context = context[first].astype(np.float64)

        offset = np.cumsum([0, *nodes])
        below = np.concatenate([which[offset[i] + np.repeat(np.arange(nodes[i]), p[4])] for i, p in enumerate(parts)])
        triple, which_triple = np.unique(below.astype(np.uint64) << np.uint64(32) | np.concatenate([p[5] for p in parts]), return_inverse=True)
        times = np.bincount(which_triple, weights=np.concatenate([p[6] for p in parts]), minlength=len(triple))
        parent, last = (triple >> np.uint64(32)).astype(np.int64), (triple & np.uint64(UNKNOWN)).astype(np.int64)

        # Levels: n-grams of training only, parents numbered among those.
        seen, seen_triple = total > 0, times > 0
        node_of = np.cumsum(seen) - 1
        roots, root_of = np.unique(pair[seen] >> np.uint64(32), return_inverse=True)
        word = (pair & np.uint64(UNKNOWN)).astype(np.int64)
        share = times[seen_triple] / (total[parent[seen_triple]] + weight_3)
        trie = Trie(
            roots,
            root_of,
            word[seen],
            quantise(total[seen] / (context[seen] + weight_2)),
            quantise(weight_3 / (total[seen] + weight_3)),
            node_of[parent[seen_triple]],
            last[seen_triple],
            quantise(share),
        )
        found, known = trie.pairs((pair >> np.uint64(32)).astype(np.int64), word)
        p2, rest = np.full(len(pair), 255, np.uint8), np.zeros(len(pair), np.uint8)
        p2[known], rest[known] = trie.uv_codes[found[known]], trie.uv_backoff[found[known]]
        found, known = trie.triples(found[parent], last)
        p3 = np.full(len(triple), 255, np.uint8)
        p3[known] = trie.uvw_codes[found[known]]
        answers, at = [], 0
        for i, p in enumerate(parts):
            own = which[offset[i] : offset[i + 1]]
            answers.append(pack(p2[own], rest[own], p3[which_triple[at : at + len(p[5])]]))
            at += len(p[5])
        return answers, None

    return answer


def scored(coded: DataFrame, answers: DataFrame, docs: tuple[int, int], totals: tuple[int, int], pairs: np.ndarray, buckets: int, limit: int, weight_2: float) -> DataFrame:
    """One row per document from its chunk's answers; ``totals``: N and V."""
    listed = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    joined = coded.join(listed, "chunk", "left").select("ids", "tokens", "numbers", "answers")
    names = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    id_type = coded.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(names).fields])
    n, v = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tokens, numbers, got = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                t = Text(tokens, numbers, docs)
                layout = Layout(t, pairs, buckets, limit)
                p2, rest = np.zeros(len(layout.pair_key)), np.ones(len(layout.pair_key))
                p3 = np.zeros(len(layout.last))
                for x in got or []:
                    b = x["bucket"]
                    a, c, d = (VALUES[y] for y in unpack(x["answer"]))
                    own = slice(layout.node_cut[b], layout.node_cut[b + 1])
                    home = ~layout.is_guest[own]
                    p2[layout.node[own][home]], rest[layout.node[own][home]] = a[home], c[home]
                    p3[layout.triples[layout.triple_cut[b] : layout.triple_cut[b + 1]]] = d
                p1 = (t.counts + 1) / (n + v + 1)
                at = np.flatnonzero(t.is_token)
                before = np.where(t.words[at - 1] != UNKNOWN, t.counts[at - 1], 0)
                below = weight_2 / (before + weight_2) * p1[at]
                place = np.full(len(t.words), -1)
                place[t.pair_at + 1] = np.arange(len(t.pair_at))
                pair = place[at]
                below += np.where(pair >= 0, p2[layout.pair_of[pair]], 0) if len(t.pair_at) else 0
                # The pair before: its back-off weight, and the triple, if seen.
                previous = np.where(place[at - 1] >= 0, place[at - 1], -1)
                full = below.copy()
                if len(t.pair_at):
                    full = np.where(previous >= 0, rest[layout.pair_of[previous]], 1.0) * below
                place[:] = -1
                place[t.triple_at + 2] = np.arange(len(t.triple_at))
                triple = place[at]
                if len(t.triple_at):
                    full += np.where(triple >= 0, p3[layout.triple_of[triple]], 0)
                doc, k = t.doc[at], len(t.lengths)
                base = np.bincount(doc, weights=np.log10(p1[at]), minlength=k)
                score = np.bincount(doc, weights=np.minimum(0, np.log10(full)), minlength=k)
                known = np.bincount(doc, weights=t.counts[at] > 0, minlength=k).astype(np.int64)
                columns = [batch.column(0)[row].values, ~t.train, t.lengths + 1, known, np.full(k, n), base, score]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    held_fold_number: int = HELD_FOLD,
    weight_2: float = WEIGHT_2,
    weight_3: float = WEIGHT_3,
    tokens_per_bucket: int = TOKENS_PER_BUCKET,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    store = Store(docs.sparkSession, "ngrams")
    fold = held_fold(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == held_fold_number).alias("held_out"), F.col(text_col).cast("binary").alias("raw"))
    found = chunks(rows, store)
    sums = found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_docs", "n_train")]).first()
    n_tokens, docs_seen = sums[0], (sums[1], sums[2])
    buckets = min(MAX_BUCKETS, 1 + n_tokens // tokens_per_bucket)
    limit = max(1, n_tokens // (2 * buckets))

    answers = store.put(answered(word_asks(found, buckets), count_words), "words")
    known = np.zeros((buckets, 2), np.int64)
    for r in answers.where("chunk < 0").collect():  # two numbers per bucket
        known[r["bucket"]] = unpack(r["answer"])[0]
    if int(known[:, 0].max()) * buckets + FIRST_WORD >= UNKNOWN:
        raise ValueError("more words than 32-bit numbers")
    coded = coded_chunks(found, answers, buckets, store)
    store.drop("chunks")
    store.drop("words")
    totals = (int(known[:, 1].sum()) + docs_seen[1], int(known[:, 0].sum()) + (docs_seen[1] > 0))

    pairs = hot_pairs(coded, docs_seen, limit)
    asks = ngram_asks(coded, docs_seen, pairs, buckets, limit)
    probabilities = answered(asks, answer_ngrams(weight_2, weight_3))
    return scored(coded, probabilities, docs_seen, totals, pairs, buckets, limit, weight_2)
