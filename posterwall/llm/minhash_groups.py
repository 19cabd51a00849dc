"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its word shingles; its sketch is the k smallest of them. Equal
sets are one class, represented by the smallest id. Inverted lists of retained values name
candidate pairs; the k smallest values of the union of both sketches estimate the similarity, with
a margin of MARGIN standard deviations; the full sets decide.

Links are needed to connect documents, not for their own sake, so lists are used in steps. First
each document meets the smallest id of its short lists. Of the ROOTS most central documents (most of whose
values are in long lists) of each of its long lists it meets the NEAREST that it has the most lists in common
with. Those not linked to one of these meet the next most central documents, up to ROUNDS. Then pairs of short
lists meet whose ends are not linked to the same root. A list is long if it holds more than LIST rows. Documents
use the first INDEX retained values whose lists are short. Those that share more than HEAVY of their sketch with
long lists use these, too. So documents form at most NEAREST pairs each in a round by long lists, however many
share a passage, and a large group of copies forms about one pair per document.

Roots alone leave near copies apart that are put together from passages which are each frequent, as
these resemble no central document of their lists. So the documents that share more than HEAVY of their
sketch with long lists are joined again exactly, by prefixes: the values of their full sets are put in one
order, the rarest among them first. Two similar sets share a value of the first n - ceil(t * n) + 1 of
each, whatever the order is, and it is among the first n - ceil(2 * t * n / (1 + t)) + 1, the short prefix, of
the smaller one. Each list of such values is met by its documents outside its largest component, in full where
one of the two has the value in its short prefix: no list, group or component is cut, and pairs that are
connected already are not formed again.

A pair of similarity t misses all INDEX values with probability (1 - t) ** INDEX. A pair at the limit
whose sets are beyond the sketch falls below the margin with the tail of the binomial distribution
of SKETCH draws, under 2e-9 at 0.8 and at 0.85; that of smaller sets is exact.

Null and empty texts, and texts without a word, have an empty set and are linked with nothing. A
null id is linked with nothing and its component is null. Rows that repeat an id are one document.
Extra columns are ignored by `components` and kept by `keep_representatives`.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from posterwall.llm.store import written
from posterwall.llm.textscan import Scan, mix, text_slices
from posterwall.session import broadcast_if_small

SKETCH = 64
INDEX = 16
LIST = 16
HEAVY = 0.35
ROUNDS = 2
ROOTS = 3
NEAREST = 2
MARGIN = 7.0
# Documents of the input for each file of a table in between, at least.
ROWS_A_FILE = 2048


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the shingles of each text, by one hash function.

    A text of fewer words than `width` has one shingle, all its words.
    """
    scan = Scan(texts, lower=True)
    words = scan.word_hash()
    doc, hashes = scan.windows(width, words)
    inside = doc >= 0
    n = scan.n_words()
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < width))
    whole = np.full(len(short), 1, np.uint64)
    for j in range(width - 1):
        has = n[short] > j
        whole[has] = mix(whole[has] + words[first[short[has]] + j])
    doc = np.concatenate([doc[inside], short])
    hashes = np.concatenate([hashes[inside], whole]) >> np.uint64(1)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))) if len(doc) else np.zeros(0, bool)
    doc, hashes = doc[new], hashes[new].astype(np.int64)
    return np.split(hashes, np.searchsorted(doc, np.arange(1, scan.n)))


def sketches(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch of every row of docs."""
    names = ["doc_id", "n_shingles", "digest", "sketch"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, width)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_shingles bigint, digest binary, sketch array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, hashes of the documents in ids; their texts are read again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, width)
                columns = [batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "hashes"])

    wanted = docs.select("doc_id", "text").join(broadcast_if_small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return wanted.mapInArrow(run, f"id {kind}, hashes array<bigint>")


class _Search:
    """Candidate search and verification over the classes of one table of documents."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.rows = written(sketches(docs, width), "minhash-sketches")
        self.files = max(1, self.rows.count() // ROWS_A_FILE)
        members = self.rows.where("n_shingles > 0 and doc_id is not null")
        # Rows of one digest have the same set, so any of their sketches is that of the class.
        first = [F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")]
        self.sketch = self.kept(members.groupBy("digest").agg(*first), "minhash-classes")
        self.classes = self.sketch.select("digest", "id")

    def kept(self, df: DataFrame, kind: str) -> DataFrame:
        """df as a written table, in files of ROWS_A_FILE documents or more."""
        return written(df, kind, self.files)

    def similar(self, inter, na, nb):
        return 100 * inter >= self.percent * (na + nb - inter)

    def sizes_fit(self, na, nb):
        """Similar sets have sizes within the similarity of each other."""
        return (100 * na >= self.percent * nb) & (100 * nb >= self.percent * na)

    def same_id(self) -> DataFrame:
        """Links between the classes of texts that share an id, as rows of an id are one document."""
        members = self.rows.where("n_shingles > 0 and doc_id is not null").select("digest", "doc_id")
        own = members.join(self.classes.hint("merge"), "digest").select("doc_id", "id")
        several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most")
        return own.join(several.hint("merge"), "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()

    def postings(self) -> DataFrame:
        """id, n, pos, value, cnt of the retained values that several classes share."""
        every = self.sketch.select("id", "n", F.posexplode("sketch").alias("pos", "value"))
        shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
        return self.kept(every.join(shared.hint("merge"), "value"), "minhash-postings")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs(a, b) that the union of both sketches does not rule out."""
        of = lambda side: self.sketch.select(F.col("id").alias(side), F.col("sketch").alias(f"s{side}"))
        both = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
        shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
        t = self.percent / 100
        least = t - MARGIN * (t * (1 - t) / SKETCH) ** 0.5
        return both.where(shared >= least * F.size(union)).select(*pairs.columns).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, inter, na, nb of pairs(a, b), from the full sets."""
        pairs = self.kept(pairs.select("a", "b").distinct(), "minhash-pairs")
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self.kept(_full_sets(self.docs, self.kept(ids, "minhash-ids"), self.width), "minhash-sets")
        of = lambda side: sets.select(F.col("id").alias(side), F.col("hashes").alias(f"h{side}")).hint("merge")
        both = pairs.join(of("b"), "b").join(of("a"), "a")
        sized = both.select(
            "a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("inter"),
            F.size("ha").cast("long").alias("na"), F.size("hb").cast("long").alias("nb"),
        )
        return self.kept(sized, "minhash-verified")

    def links(self) -> DataFrame:
        """Linked classes a, b: enough of them to connect all that are connected."""
        postings = self.postings()
        heavy = postings.where(F.col("cnt") > LIST)
        weight = self.kept(heavy.groupBy("id").agg(F.count(F.lit(1)).alias("heavy"), F.sum(F.log2("cnt")).alias("central")), "minhash-heavy")

        light = postings.where(F.col("cnt") <= LIST).join(weight.select("id", "heavy").hint("merge"), "id", "left")
        light = light.where(F.col("pos") < INDEX + F.coalesce("heavy", F.lit(0))).select("id", "n", "value")
        left = light.select("value", F.col("id").alias("a"), F.col("n").alias("na"))
        right = light.select("value", F.col("id").alias("b"), F.col("n").alias("nb"))
        met = left.join(right.hint("merge"), "value").where((F.col("a") < F.col("b")) & self.sizes_fit(F.col("na"), F.col("nb")))
        overlaps = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
        pairs = self.kept(self.estimated(overlaps.select("a", "b")), "minhash-candidates")
        roots = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")

        # Long lists: those documents only that mostly consist of what very many share.
        size = F.least(F.col("n"), F.lit(SKETCH))
        mostly = heavy.join(weight.hint("merge"), "id").where(F.col("heavy") > HEAVY * size)
        self.shared = self.kept(mostly.select("id").distinct(), "minhash-shared")
        rank = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
        mostly = mostly.withColumn("rank", rank).where(F.col("rank") <= INDEX)
        mostly = self.kept(mostly.select("id", "n", "value", "heavy", "central"), "minhash-long")
        met = self.kept(self._rooted(mostly, mostly), "minhash-rooted")
        tested = self.verified(roots.unionByName(self.estimated(met)))
        linked = self._similar(tested)
        # Those that their roots did not take meet the next most central documents of their lists.
        for _ in range(ROUNDS - 1):
            used = met.select(F.col("a").alias("id")).distinct()
            taken = met.join(linked.hint("merge"), ["a", "b"], "left_semi").select(F.col("b").alias("id")).unionAll(used).distinct()
            apart = mostly.join(taken.hint("merge"), "id", "left_anti")
            more = self.kept(self._rooted(mostly.join(used.hint("merge"), "id", "left_anti"), apart), "minhash-rooted")
            found = self.verified(self.estimated(more))
            tested, met, linked = tested.unionByName(found), met.unionByName(more), linked.unionByName(self._similar(found))

        root = linked.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("root"))
        rest = self._unrooted(pairs, root).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        return linked.unionByName(self._similar(self.verified(rest)))

    def _rooted(self, leaders: DataFrame, members: DataFrame) -> DataFrame:
        """a, b: each member and the NEAREST of the most central leaders of its lists, by the lists in common; sizes must fit."""
        order = Window.partitionBy("value").orderBy(F.desc("heavy"), F.desc("central"), "id")
        best = leaders.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROOTS)
        best = best.select("value", F.col("id").alias("a"), F.col("n").alias("na"), F.col("heavy").alias("ha"), F.col("central").alias("ca"))
        met = members.select("value", F.col("id").alias("b"), F.col("n").alias("nb")).join(best.hint("merge"), "value")
        met = met.where((F.col("a") != F.col("b")) & self.sizes_fit(F.col("na"), F.col("nb")))
        common = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("ha").alias("ha"), F.max("ca").alias("ca"))
        # Equally near ones by centrality, so that the members of a group agree.
        near = Window.partitionBy("b").orderBy(F.desc("common"), F.desc("ha"), F.desc("ca"), "a")
        return common.withColumn("place", F.row_number().over(near)).where(F.col("place") <= NEAREST).select("a", "b")

    def prefix_links(self, found: DataFrame) -> DataFrame:
        """Links between the components found(id, component) among the documents of long lists, by prefixes of their full sets."""
        prefixes = self.kept(self._prefixes(found), "minhash-prefixes")
        parts = prefixes.groupBy("value", "component").agg(F.count(F.lit(1)).alias("cnt"))
        several = parts.groupBy("value").agg(F.count(F.lit(1)).alias("several"), F.max_by("component", "cnt").alias("main"))
        lists = prefixes.join(several.where("several > 1").select("value", "main").hint("merge"), "value")
        # The smaller one of a pair has the value in its short prefix, so of two rows one is short.
        lists = lists.withColumn("short", (100 + self.percent) * (F.col("n") - F.col("pos")) >= 2 * self.percent * F.col("n"))
        of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n", "pos")]
        partners = F.when(F.col("short"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
        left = lists.where("component <> main").select("value", *of("a"), F.explode(partners).alias("short"))
        right = lists.select("value", *of("b"), "short")
        # Of the values both share the first one in the order is at places that leave enough for the rest.
        rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        fit = (100 + self.percent) * rest >= self.percent * (F.col("n_a") + F.col("n_b"))
        met = left.join(right.hint("merge"), ["value", "short"]).where((F.col("component_a") != F.col("component_b")) & fit)
        pairs = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
        return self._similar(self.verified(self.estimated(pairs)))

    def _prefixes(self, found: DataFrame) -> DataFrame:
        """id, component, n, value, pos of the prefixes of the sets of long lists, the rarest values first; values of one set are left out."""
        sets = _full_sets(self.docs, self.shared.select("id"), self.width).withColumn("part", F.xxhash64("hashes"))
        # An id may have several texts, and one text several times.
        sets = sets.groupBy("id", "part").agg(F.any_value("hashes").alias("hashes"))
        sets = sets.join(found.hint("merge"), "id", "left").select("id", "part", F.coalesce("component", "id").alias("component"), "hashes")
        sets = self.kept(sets.withColumn("n", F.size("hashes").cast("long")), "minhash-sets")
        values = sets.select("id", "part", "component", "n", F.explode("hashes").alias("value"))
        counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
        shared = values.join(counts.hint("merge"), "value").groupBy("id", "part").agg(
            F.any_value("component").alias("component"), F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("cnt", "value"))).alias("shared")
        )
        # What one set has alone stands before all of these.
        first = F.col("n") - F.size("shared")
        length = F.floor((100 - self.percent) * F.col("n") / 100) + 1
        prefix = F.slice("shared", F.lit(1), F.greatest(length - first, F.lit(0)).cast("int"))
        at = shared.select("id", "component", "n", first.alias("first"), F.posexplode(prefix).alias("pos", "v"))
        return at.select("id", "component", "n", F.col("v.value").alias("value"), (F.col("first") + F.col("pos")).alias("pos"))

    def _similar(self, sized: DataFrame) -> DataFrame:
        return sized.where(self.similar(F.col("inter"), F.col("na"), F.col("nb"))).select("a", "b")

    def _unrooted(self, pairs: DataFrame, root: DataFrame) -> DataFrame:
        """The pairs whose ends are not linked to the same root."""
        of = lambda side: root.select(F.col("id").alias(side), F.col("root").alias(f"r{side}")).hint("merge")
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def connected(links: DataFrame, files: int | None = None) -> DataFrame:
    """id, component (smallest id reachable) of the ends of links(a, b).

    Each round takes the smallest label among a document and its neighbours and then the label of
    that label, so long chains shorten fast. Rounds are written tables; it ends when none changes.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    edges = written(both.distinct(), "components-edges", files)
    labels = written(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "components", files)
    while True:
        of = labels.select(F.col("id").alias("other"), F.col("component").alias("theirs"))
        near = edges.join(of.hint("merge"), "other").groupBy("id").agg(F.min("theirs").alias("near"))
        lower = labels.join(near.hint("merge"), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = lower.join(jump.hint("merge"), "component").select("id", "was", F.least("component", "next").alias("component"))
        new = written(new, "components", files)
        if new.where("component <> was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    Documents are linked when the sets of their shingles of `width` words have a similarity of at
    least percent / 100. kept marks the smallest id of each component.
    """
    search = _Search(docs, width, percent)
    links = search.kept(search.links().unionByName(search.same_id()), "minhash-links")
    found = connected(links, search.files)
    more = search.kept(search.prefix_links(found), "minhash-links")
    if not more.isEmpty():
        found = connected(links.unionByName(more), search.files)
    groups = search.classes.join(found.hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    held = search.rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    whole = held.join(groups.hint("merge"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("c"))
    # An id whose rows have several texts has the smallest component of them; its classes are linked, only empty texts differ.
    whole = search.kept(whole, "minhash-whole")
    several = whole.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    several = broadcast_if_small(search.kept(several.where("least <> most").select("doc_id", "least"), "minhash-several"))
    whole = whole.join(several, "doc_id", "left").withColumn("c", F.coalesce("least", "c"))
    return whole.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
        F.coalesce(F.col("c") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns."""
    found = written(components(docs, width, percent), "minhash-kept")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(dropped), "doc_id", "left_anti")
    if found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.unionByName(kept.where("doc_id is null"))
