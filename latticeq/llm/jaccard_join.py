"""Exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

Shingles are ordered rare first (a table of the most frequent ones gives the order; all others come before it, by
hash). Of a set of n shingles the prefix has n - ceil(t n) + l members: two sets of similarity t share at least
min(l, l') members of their prefixes. Each document picks the l for which its estimated candidate cost, from the
frequency table, is least. A pair is verified only if it was met in min(l, l') buckets.

Links are needed only as components, so pairs inside one component are never all made:

1. equal sets are one node with one posting for each prefix member; members held by a single node go;
2. within each member's bucket every node is paired with one leader, the node with the least share of rare shingles (an
   original has fewer of them than its edited copies): as many pairs as rows;
3. components of the links found; buckets inside one component are done;
4. in the others a leader is taken from outside the bucket's largest component and paired with the nodes of other
   components, and components are taken again, ``TURNS`` times: again no more pairs than rows;
5. in what is still divided, nodes of different components are paired, and components are taken again. Every pair over
   the threshold is thus linked, directly or through its component.

Before members are fetched to verify a pair, the sets' parity bitmaps must not differ in more bits than the sets may.
One plan serves every size: a bitmap of bounded size thins out the documents before the join that fetches members.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace, bitmap, broadcast, lean, marked, most_frequent
from latticeq.llm.tokens import HashIndex, Tokenizer, pieces, text_buffer, windows
from latticeq.operators.graph import components

#: Frequent shingles that are ordered by count (any others: by hash; this sets the cost, never the result), counts
#: below which a task doesn't report a shingle, shingles a task counts at a time.
FREQUENT, REPORTED, AT_A_TIME = 500_000, 2, 1_000_000
#: Nodes of one bucket that share a leader, longest multi-match, turns of step 4, 64-bit words of a set's parity bitmap
#: (more for large sets) and of its short form.
BUCKET, MOST, TURNS, BITS, FEW = 4096, 8, 2, 16, 4
#: Numbers in a batch that a task gives back (a longer text: alone).
HELD = 1 << 20

_POSTING = ("odd", "node", "n", "match", "pos")


def shingle_sets(column: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text; fewer words than ``width``: all of them as one; none: empty."""
    tokenizer = Tokenizer()
    data, at = text_buffer(column)
    for lo, hi in pieces(at):
        words, _, first = tokenizer(data, at[lo : hi + 1])
        grams = windows(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(grams[a : b - width + 1]) if b - a >= width else windows(words[a:b], b - a) if b > a else grams[:0]


def _node(members: np.ndarray, seed: int) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16, key=seed.to_bytes(4, "big")).digest()


def _parity(members: np.ndarray) -> np.ndarray:
    """Bitmap of which buckets hold an odd number of members: two of them differ in no more bits than the sets do.

    It has two bits or more for each member, in a power of two of words, so that halving it adds up its halves.
    """
    words = max(BITS, 1 << (max(1, len(members) // 32) - 1).bit_length())
    odd = np.bincount((members & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _first_long(sign: bytes) -> int:
    return int.from_bytes(sign[:8], "big", signed=True)


_ROW = {"n": pa.int64(), "node": pa.int64(), "sign": pa.binary(), "many": pa.int64(), "bits": pa.list_(pa.int64()), "fold": pa.list_(pa.int64())}


def _counting(width: int, seed: int):
    def run(batches):
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        many = 0
        for batch in batches:
            sizes, signs, bits = [], [], []
            for members in shingle_sets(batch.column("text"), width):
                sizes.append(len(members))
                signs.append(sign := _node(members, seed))
                bits.append(_parity(members))
                if len(members) and sign not in seen:
                    seen.add(sign)
                    held.append(members)
                    many += len(members)
            k = len(sizes)
            ends = np.cumsum([0] + [len(x) for x in bits]).astype(np.int32)
            # the short form: words that fall together are added bit by bit
            short = [np.bitwise_xor.reduce(x.reshape(-1, FEW), axis=0) for x in bits]
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for at, x in ((ends, bits), (np.arange(k + 1, dtype=np.int32) * FEW, short))]
            columns = [pa.array(sizes, pa.int64()), pa.array([_first_long(x) for x in signs], pa.int64()), pa.array(signs, pa.binary()), pa.nulls(k, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), *columns], names=["id", "same", *_ROW])
            if many >= AT_A_TIME:
                yield counted(batch, held)
                held, many = [], 0
        if many:
            yield counted(batch, held)

    def counted(batch, held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= REPORTED
        k = int(often.sum())
        known = {"n": pa.array(np.full(k, -1)), "node": pa.array(tokens[often].view(np.int64)), "many": pa.array(counts[often])}
        columns = [known[x] if x in known else pa.nulls(k, kind) for x, kind in _ROW.items()]
        return pa.RecordBatch.from_arrays([pa.nulls(k, batch.schema.field("id").type), pa.nulls(k, pa.int64()), *columns], names=["id", "same", *_ROW])

    return run


def prefix(members: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Indexes of the prefix of a sorted set and its multi-match l. counts: of the frequent members, 0 for others."""
    n = len(members)
    need = -(-least * n // 100)
    order = np.lexsort((members, counts)) if counts.any() else np.arange(n)
    cost = np.cumsum(np.maximum(counts[order], 1))
    best, at = math.inf, 1
    for k in range(1, min(MOST, need) + 1):
        if (c := cost[n - need + k - 1] / k) < best:
            best, at = c, k
        if cost[n - need] <= 4 * (n - need + 1):
            break
    return order[: n - need + at], at


def _flushed(made, size):
    """Batches of about ``HELD`` numbers from a stream of (arrays, numbers): what a task holds doesn't grow with its batches."""
    held, many = [], 0
    for part in made:
        held.append(part)
        many += size(part)
        if many >= HELD:
            yield held
            held, many = [], 0
    if held:
        yield held


def _prefixes(width: int, seed: int, least: int, frequent):
    def run(batches):
        index, many = frequent.value
        seen: set[bytes] = set()

        def postings():
            for batch in batches:
                for members in shingle_sets(batch.column("text"), width):
                    if not len(members) or (sign := _node(members, seed)) in seen:
                        continue
                    seen.add(sign)
                    at = index(members)
                    counts = np.where(at >= 0, many[at], 0) if len(many) else np.zeros(len(members), np.int64)
                    chosen, k = prefix(members, counts, least)
                    size, node, buckets = len(chosen), _first_long(sign), counts[chosen] // BUCKET + 1
                    odd = 1000 * int(np.count_nonzero(counts == 0)) // len(members)
                    yield members[chosen].view(np.int64), node % buckets, buckets, np.full(size, odd), np.full(size, node), np.full(size, len(members)), np.full(size, k), np.arange(size)

        for held in _flushed(postings(), lambda part: 8 * len(part[0])):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*held)], names=["token", "salt", "salts", *_POSTING])

    return run


def _members(width: int):
    def run(batches):
        def sets():
            for batch in batches:
                yield from zip(batch.column("node").to_pylist(), (x.view(np.int64) for x in shingle_sets(batch.column("text"), width)))

        for held in _flushed(sets(), lambda part: len(part[1])):
            ends = np.cumsum([0] + [len(x) for _, x in held]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in held])))], names=["node", "members"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, least: int) -> None:
        self.spark, self.width, self.least = docs.sparkSession, width, least
        self.work = Workspace(self.spark, "jaccard")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("same"))
        self.kind = docs.schema[id_col].dataType.simpleString()

    def classes(self) -> None:
        """Sets of equal members as nodes, and the table of frequent shingles."""
        seed = 0
        while True:
            schema = f"id {self.kind}, same long, n long, node long, sign binary, many long, bits array<long>, fold array<long>"
            made = self.work.table(self.docs.mapInArrow(lean(_counting(self.width, seed)), schema))
            clash = made.filter("n > 0").groupBy("node").agg(F.min("sign").alias("p"), F.max("sign").alias("q")).filter("p <> q")
            if clash.isEmpty():
                break
            seed += 1
        self.seed, self.rows = seed, made.filter("n >= 0")
        top = made.filter("n < 0").groupBy("node").agg(F.sum("many").alias("many")).filter(F.col("many") >= 2 * REPORTED)
        top = most_frequent(self.work.table(top), "node", "many", FREQUENT)
        tokens, many = top["node"].to_numpy(np.int64).view(np.uint64), top["many"].to_numpy(np.int64)
        self.frequent = broadcast(self.spark, (HashIndex(tokens), many))
        self.heads = self.rows.filter("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "same")).alias("head"))
        self.maps = self.work.table(self.rows.filter("n > 0 AND id IS NOT NULL").select("node", "n", "bits", "fold").dropDuplicates(["node"]))

    def buckets(self) -> DataFrame:
        """Prefix members that two nodes hold at least, each with the leader of its bucket."""
        schema = "token long, salt long, salts long, odd long, node long, n long, match long, pos long"
        rows = self.docs.filter("id IS NOT NULL").mapInArrow(lean(_prefixes(self.width, self.seed, self.least, self.frequent)), schema)
        keys = "token", "salt"
        # a set that stands in several tasks has a posting from each; the first one stays
        rows = rows.withColumn("before", F.lag("node").over(Window.partitionBy(*keys).orderBy("node"))).filter("before IS NULL OR before <> node")
        bucket, posting = Window.partitionBy(*keys), F.struct(*_POSTING)
        held = rows.withColumns({"lead": F.min(posting).over(bucket), "last": F.max(posting).over(bucket), "size": F.count(F.lit(1)).over(bucket)})
        # the two nodes of a bucket have no other partner in it
        held = held.withColumn("pair", F.expr("size = 2 AND salts = 1")).filter("size > 1 OR salts > 1").filter(~F.col("pair") | self.near("lead.{}", "last.{}"))
        once = F.col("pair") & (F.least("lead.match", "last.match") == 1)
        return self.work.table(held.select("token", "salts", *_POSTING, "lead", once.alias("once")))

    def near(self, x: str, y: str):
        """Whether a shared member can be among the first l shared ones of a pair over the threshold.

        x and y are templates of column names. The pair has o = ceil(t (n + m) / (1 + t)) members in common at least;
        n - o others come before the first of them, and n - o + l - 1 before the l-th.
        """
        n, m = F.col(x.format("n")), F.col(y.format("n"))
        o = F.ceil(self.least * (n + m) / F.lit(100 + self.least) - F.lit(1e-9))
        k = F.least(x.format("match"), y.format("match")) - 1
        return (100 * F.least(n, m) >= self.least * F.greatest(n, m)) & (F.col(x.format("pos")) <= n - o + k) & (F.col(y.format("pos")) <= m - o + k)

    def close(self, x: str, y: str, bits: str):
        """Whether the bitmaps of a pair differ in no more bits than sets over the threshold may."""
        n, m, p, q = F.col(x.format("n")), F.col(y.format("n")), F.col(x.format(bits)), F.col(y.format(bits))
        o = F.ceil(self.least * (n + m) / F.lit(100 + self.least) - F.lit(1e-9))
        if bits == "fold":
            differ = sum((F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(FEW)), F.lit(0))
        else:  # sizes that may go together differ by less than two, so one halving makes the bitmaps of a pair equally long
            halved = lambda u, v: F.when(F.size(u) > F.size(v), F.zip_with(F.slice(u, 1, F.size(v)), F.slice(u, F.size(v) + 1, F.size(v)), lambda x, y: x.bitwiseXOR(y))).otherwise(u)
            differ = F.aggregate(F.zip_with(halved(p, q), halved(q, p), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, d: t + d)
        return differ <= n + m - 2 * o

    def often(self, met: DataFrame) -> DataFrame:
        """Pairs (a, b) with a < b of met (x, y, need) that were met as often as they need."""
        pairs = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
        return pairs.filter("shared >= need").select("a", "b")

    def met(self, rows: DataFrame, x: str, y: str) -> DataFrame:
        """Rows whose nodes x and y (templates of column names) differ and are near, as (x, y, need)."""
        a, b = F.col(x.format("node")), F.col(y.format("node"))
        return rows.filter(a != b).filter(self.near(x, y)).select(a.alias("x"), b.alias("y"), F.least(x.format("match"), y.format("match")).alias("need"))

    def led(self, held: DataFrame) -> DataFrame:
        """Pairs of nodes with the leaders of their buckets, and of leaders of one member's buckets."""
        leads = held.filter("salts > 1").groupBy("token", "lead").agg(F.lit(1).alias("one"))
        across = leads.join(leads.groupBy("token").agg(F.min("lead").alias("top")), "token")
        return self.often(self.met(held, "lead.{}", "{}").unionByName(self.met(across, "top.{}", "lead.{}")))

    def fetched(self, nodes: DataFrame) -> DataFrame:
        """(node, members) of the nodes of a table; a bitmap of their documents thins out the texts before the shuffle."""
        ids = self.work.table(nodes.join(self.heads, "node").select("node", F.col("head.id").alias("id"), F.col("head.same").alias("same")))
        some = marked(self.docs, bitmap(ids, "id", "same"), "id", "same")
        # repeated rows go where the join has put them
        texts = some.join(ids.hint("merge"), ["id", "same"]).dropDuplicates(["id", "same"]).select("node", "text")
        return self.work.table(texts.mapInArrow(lean(_members(self.width)), "node long, members array<long>"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those pairs that are over the threshold, by full comparison of their members."""
        for bits in ("fold", "bits"):  # the short bitmaps discard most, so that few pairs carry the long ones
            a, b = (self.maps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(bits).alias(f"{bits}_{x}")) for x in "ab")
            pairs = self.work.table(pairs.join(a, "a").join(b, "b").filter(self.close("{}_a", "{}_b", bits)).select("a", "b"))
        sets = self.fetched(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"in_{x}")) for x in "ab")
        rows = pairs.join(right, "b").join(left, "a")
        rows = rows.select("a", "b", F.size(F.array_intersect("in_a", "in_b")).cast("long").alias("common"), (F.size("in_a") + F.size("in_b")).cast("long").alias("both"))
        links = self.work.table(rows.filter(100 * F.col("common") >= self.least * (F.col("both") - F.col("common"))).select("a", "b"))
        self.work.drop(sets)
        return links

    def divided(self, held: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their own and the bucket's main label."""
        named = held.join(labels, "node", "left").select("token", *_POSTING, F.coalesce("label", "node").alias("label"))
        sizes = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
        mixed = sizes.groupBy("token").agg(F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("kinds"))
        mixed = self.work.table(mixed.filter("kinds > 1").select("token", F.col("main.label").alias("main")))
        return self.work.table(named.join(mixed, "token"))

    def turned(self, divided: DataFrame, turn: int) -> DataFrame:
        """Pairs of nodes with a leader of another component, taken from outside their bucket's largest one."""
        order = [F.col("odd") if turn == 0 else F.xxhash64("node", F.lit(turn))]
        leads = divided.filter("label <> main").groupBy("token").agg(F.min(F.struct(*(x.alias("first") for x in order), *_POSTING, "label")).alias("lead"))
        return self.often(self.met(divided.join(leads, "token").filter("label <> lead.label"), "lead.{}", "{}"))

    def rest(self, divided: DataFrame) -> DataFrame:
        """Pairs of nodes of different components: of each member's nodes, those outside its largest component with all."""
        divided = self.work.table(divided.join(self.maps.select("node", "fold"), "node"))
        few = divided.filter("label <> main").select("token", *(F.col(c).alias(f"{c}_a") for c in (*_POSTING, "label", "fold")))
        pairs = few.join(divided, "token").filter("label <> label_a AND (label = main OR node_a < node)").filter(self.near("{}", "{}_a")).filter(self.close("{}", "{}_a", "fold"))
        return self.often(self.met(pairs, "{}_a", "{}"))

    def run(self) -> DataFrame:
        self.classes()
        held = self.buckets()
        tried = self.work.table(self.led(held))
        links = self.verify(tried)
        labels = components(links, self.work)
        held = held.filter("NOT once")  # a bucket of two nodes has had its only pair, unless that needs other buckets too
        for turn in range(TURNS + 1):
            divided = self.divided(held, labels)
            held = divided.select("token", *_POSTING)  # what is settled stays so
            pairs = self.turned(divided, turn) if turn < TURNS else self.rest(divided)
            pairs = self.work.table(pairs.join(tried, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                continue
            more = self.verify(pairs)
            tried = tried.unionByName(pairs)
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = components(links, self.work)
        rows = self.rows.filter("n > 0 AND id IS NOT NULL").join(labels, "node", "left").select("id", "same", "n", F.coalesce("label", "node").alias("label"))
        rows = self.work.table(rows)
        firsts = rows.groupBy("label").agg(F.min(F.struct("id", "same")).alias("first"))
        alone = self.rows.filter("n = 0 OR id IS NULL").select("id", "same", "n", F.struct("id", "same").alias("first"))
        return rows.join(self.work.table(firsts), "label").select("id", "same", "n", "first").unionByName(alone)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest identifier reachable by links, itself included).

    Two documents link when 100 * common >= percent * united distinct ``width``-word shingles. A text of fewer words is
    one shingle; null or blank texts have none and link with nothing. Rows with a null identifier are counted but link
    with nothing (component null). Repeated rows come out repeated; an identifier with several texts links each of
    them. Texts are taken whole, however long. Other columns are ignored. An empty table gives an empty result.
    """
    out = _Join(docs, id_col, text_col, width, percent).run()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, as they are, without all but one text of each component of ``jaccard_join``.

    The smallest identifier stays (of one identifier with several such texts, the text of the smallest hash); repeated
    rows of that text stay together. Rows with a null identifier, or without a word, stay.
    """
    join = _Join(docs, id_col, text_col, width, percent)
    # names that no column of the documents has
    gone = join.run().filter(F.struct("id", "same") > F.col("first")).select(F.col("id").alias("latticeq id"), F.col("same").alias("latticeq same")).distinct()
    gone = join.work.table(gone)
    bits = join.work.table(bitmap(gone, F.col("`latticeq id`"), F.col("`latticeq same`")))
    key = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    clear = marked(docs, bits, *key, how="left_anti")
    rest = marked(docs, bits, *key).join(gone.hint("merge"), (key[0] == F.col("`latticeq id`")) & (key[1] == F.col("`latticeq same`")), "left_anti")
    return clear.unionAll(rest)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of near copies among all ``documents``."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
