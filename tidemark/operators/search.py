"""Full-text search over an inverted index that is a DataFrame (term, field, id, tf, positions), and an index that is kept."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .store import settled

FIELDS = ("title", "content", "summary", "category", "author")
TERM = r"([\p{L}\p{N}]+)"


def _group_words(fields: tuple[str, ...], most: int):
    """Task: (id, words of each field) in, postings out, sorted by term, field and id in runs of up to about `most` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(fields, pa.string())
        place = np.argsort(np.argsort(np.array(fields, object)))
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(batch.column(f"t{k}")), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields)))
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                b = batch.slice(low, high - low)
                words, rows, own, at = [], [], [], []
                for k in range(len(fields)):
                    n = pc.fill_null(pc.list_value_length(b.column(f"t{k}")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    words.append(b.column(f"t{k}").flatten())
                    rows.append(np.repeat(np.arange(len(n)), n))
                    own.append(np.full(int(n.sum()), k))
                    at.append(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                coded = pa.concat_arrays(words).dictionary_encode()
                if not len(coded):
                    continue
                row, field, pos = np.concatenate(rows), np.concatenate(own), np.concatenate(at).astype(np.int32)
                by_term = pc.sort_indices(coded.dictionary).to_numpy()
                term = np.empty(len(by_term), np.int64)
                term[by_term] = np.arange(len(by_term))
                ids = pc.rank(b.column("id"), tiebreaker="min").to_numpy().astype(np.int64)[row]
                key = (term[coded.indices.to_numpy()] * len(fields) + place[field]) * (b.num_rows + 1) + ids
                order = np.lexsort((pos, key))
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                ends = np.append(first, len(key))
                some = order[first]
                columns = [
                    coded.dictionary.take(coded.indices.take(pa.array(some))).cast(pa.string()),
                    names.take(pa.array(field[some])),
                    b.column("id").take(pa.array(row[some])),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order])),
                ]
                out = pa.RecordBatch.from_arrays(columns, names=["term", "field", "id", "tf", "positions"])
                for i in range(0, out.num_rows, 100_000):
                    yield out.slice(i, 100_000)

    return run


def build_index(items: DataFrame, fields: tuple[str, ...] = FIELDS, most: int = 1_000_000) -> DataFrame:
    """(term, field, id, tf, positions) of each item. Words are grouped inside their item's task, so no posting is shuffled; rows that
    repeat an id may give a posting each, which searches read as one."""
    terms = (F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(TERM), F.lit(1)).alias(f"t{k}") for k, f in enumerate(fields))
    kind = items.schema["id"].dataType.simpleString()
    return items.select("id", *terms).mapInArrow(_group_words(fields, most), f"term string, field string, id {kind}, tf long, positions array<int>")


def phrase_ids(index: DataFrame, terms: list[str], field: str | None = None) -> DataFrame:
    """Ids of items in which the terms follow each other in one field: positions less the terms' places meet in one start."""
    rows = index.filter(F.col("term").isin(*set(terms)))
    if field:
        rows = rows.filter(F.col("field") == field)
    starts = lambda k: F.transform("positions", lambda p: F.struct((p - k).alias("start"), F.lit(k).alias("place")))
    shifted = [F.when(F.col("term") == t, starts(k)) for k, t in enumerate(terms)]
    at = rows.select("id", "field", F.explode(F.flatten(F.array_compact(F.array(*shifted)))).alias("at")).select("id", "field", "at.*")
    return at.groupBy("id", "field", "start").agg(F.countDistinct("place").alias("n")).filter(F.col("n") == len(terms)).select("id").distinct()


def search(index: DataFrame, items: DataFrame, query: str, category: str | None = None, min_importance: int | None = None, limit: int | None = 50) -> DataFrame:
    """Items with all terms of the query. `a OR b` needs one of both, `NOT a` none, `abc*` a term that starts so, `field:a`
    a term of that field, `"a b"` the terms one after another in one field. Ordered by importance and date."""
    groups: list[tuple[bool, list[str]]] = []
    words, negate, either = re.findall(r'(?:\w+:)?"[^"]*"|\S+', query), False, False
    for w in words:
        if w == "NOT":
            negate = True
        elif w == "OR":
            either = True
        elif w != "AND":
            if either and groups:
                groups[-1][1].append(w)
            else:
                groups.append((negate, [w]))
            negate = either = False

    def phrase(w: str) -> tuple[list[str], str] | None:
        field, quote, text = w.partition('"')
        return (re.findall(r"[^\W_]+", text.lower()), field.rstrip(":")) if quote and text.endswith('"') else None

    def ids_of(ws: list[str]) -> list[DataFrame]:
        """Ids of the phrases among ws; other words are matched on the index's rows."""
        return [phrase_ids(index, *p) for p in map(phrase, ws) if p and p[0]]

    def match(w: str):
        if phrase(w):
            return F.lit(False)
        field, _, term = w.rpartition(":")
        term = term.lower()
        hit = F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term
        return hit & (F.col("field") == field) if field else hit

    def any_of(ws: list[str]):
        out = match(ws[0])
        for w in ws[1:]:
            out = out | match(w)
        return out

    wanted = [ws for no, ws in groups if not no]
    out = items
    if wanted:
        tags = F.array_compact(F.array(*(F.when(any_of(ws), k) for k, ws in enumerate(wanted))))
        hits = index.filter(any_of([w for ws in wanted for w in ws])).select("id", F.explode(tags).alias("g"))
        for k, ws in enumerate(wanted):
            for found in ids_of(ws):
                hits = hits.unionByName(found.withColumn("g", F.lit(k)))
        out = out.join(hits.groupBy("id").agg(F.countDistinct("g").alias("_n")).filter(F.col("_n") == len(wanted)).select("id"), "id", "left_semi")
    for ws in (ws for no, ws in groups if no):
        gone = index.filter(any_of(ws)).select("id")
        for found in ids_of(ws):
            gone = gone.unionByName(found)
        out = out.join(gone.distinct(), "id", "left_anti")
    if category is not None:
        out = out.filter(F.col("category") == category)
    if min_importance is not None:
        out = out.filter(F.col("importance_score") >= min_importance)
    out = out.orderBy(F.desc_nulls_last("importance_score"), F.desc_nulls_last("published_at"), "id")
    return out.limit(limit) if limit is not None else out


def file_state(*tables: DataFrame) -> str:
    """A mark of the files behind tables: their names, sizes and times. It takes no column of the rows."""
    marks = []
    for df in tables:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        n, mark = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()
        marks.append(f"{n}:{mark}")
    return ",".join(marks)


class SearchIndex:
    """An inverted index at a path, in segments. A write adds one segment with the postings of the items that changed and an entry for
    each of them: (id, digest of its fields), the digest being null for an item that was deleted. An item's postings are those of the
    last segment with an entry for it. A write takes in the segments at the end while the one before has at most twice the items, so there
    are about as many as the logarithm of the items, and a posting is rewritten as seldom; new postings are written once. Postings are
    sorted by term in runs in each file, so a search for terms or starts of terms reads pages of them; a common term lies in all files.

    A version is a list of segments and counts when that small file stands, which is written last: a lost run leaves the version before
    in force. One writer at a time. Ids are unique; items without id aren't indexed; null fields are empty."""

    POSTINGS = "term string, field string, id long, tf long, positions array<int>, seq long"
    ENTRIES = "id long, digest string, seq long"
    COMMITS = "version string, segment string, seq long, items long, state string"

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        spark.createDataFrame([], self.COMMITS).write.mode("append").parquet(f"{self.path}/commits")

    def segments(self) -> list[Row]:
        """The segments of the last version, oldest first; one without a name if it has none."""
        commits = self.spark.read.schema(self.COMMITS).parquet(f"{self.path}/commits")
        last = commits.agg(F.max("version")).first()[0]
        return commits.filter(F.col("version") == last).orderBy("seq").collect() if last else []

    def _read(self, kind: str, schema: str, segments: list[Row]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{s['segment']}" for s in segments if s["segment"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _last(self, segments: list[Row], new: DataFrame | None = None) -> DataFrame:
        """(id, digest, seq) of the last entry of each item, in segments and entries that are yet to be written."""
        entries = self._read("entries", self.ENTRIES, segments)
        return (entries.unionByName(new) if new is not None else entries).groupBy("id").agg(F.max_by("digest", "seq").alias("digest"), F.max("seq").alias("seq"))

    def _live(self, segments: list[Row], new: DataFrame | None = None) -> DataFrame:
        rows = self._read("postings", self.POSTINGS, segments)
        if len(segments) < 2 and new is None:
            return rows
        later = self._last(segments[1:], new).select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))
        return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), "left_anti")

    def postings(self) -> DataFrame:
        """The index as `search` and `phrase_ids` read it."""
        return self._live(self.segments()).drop("seq")

    def entries(self) -> DataFrame:
        """(id, digest) of the items that are indexed."""
        return self._last(self.segments()).filter("digest is not null").select("id", "digest")

    def _commit(self, segments: list[Row], state: str | None) -> None:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows = [(version, s["segment"], s["seq"], s["items"], state) for s in segments] or [(version, "", 0, 0, state)]
        self.spark.createDataFrame(rows, self.COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _segment(self, entries: DataFrame, postings: DataFrame, seq: int) -> Row:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        entries.select("id", "digest", F.lit(seq).cast("long").alias("seq")).write.parquet(f"{self.path}/entries/{name}")
        columns = ["term", "field", "id", "tf", "positions"]
        postings.select(*columns, F.lit(seq).cast("long").alias("seq")).write.parquet(f"{self.path}/postings/{name}")
        return Row(segment=name, seq=seq, items=self._read("entries", self.ENTRIES, [Row(segment=name)]).count())

    def _add(self, segments: list[Row], entries: DataFrame, postings: DataFrame) -> list[Row]:
        """entries: (id, digest), settled; postings: those of its items."""
        segments = [s for s in segments if s["segment"]]
        seq = segments[-1]["seq"] + 1 if segments else 1
        first, n = len(segments), entries.count()
        while first and segments[first - 1]["items"] <= 2 * n:
            first -= 1
            n += segments[first]["items"]
        if tail := segments[first:]:
            new = entries.select("id", "digest", F.lit(seq).cast("long").alias("seq"))
            old = self._live(tail, new).drop("seq").sortWithinPartitions("term", "field", "id")
            last = self._last(tail, new)
            # before the first segment there is nothing that a deletion could hide
            entries = last if first else last.filter("digest is not null")
            postings = old.unionByName(postings.select(*old.columns))
        return [*segments[:first], self._segment(entries, postings, seq)]

    def _digest(self) -> Column:
        return F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(self.fields)))), 256)

    def _upserted(self, segments: list[Row], items: DataFrame) -> list[Row]:
        marked = items.filter("id is not null").select(F.col("id").cast("long").alias("id"), *self.fields, self._digest().alias("digest"))
        known = any(s["segment"] for s in segments)
        changed = marked.select("id", "digest")
        if known:
            changed = changed.join(self._last(segments).filter("digest is not null").select("id", "digest"), ["id", "digest"], "left_anti")
        changed = settled(changed, "changed-items")
        if changed.isEmpty():
            return segments
        return self._add(segments, changed, build_index(marked.join(changed.select("id"), "id", "left_semi") if known else marked, self.fields))

    def _deleted(self, segments: list[Row], gone: DataFrame) -> list[Row]:
        gone = settled(gone.select("id", F.lit(None).cast("string").alias("digest")), "gone-items")
        return segments if gone.isEmpty() else self._add(segments, gone, self.spark.createDataFrame([], self.POSTINGS))

    def _write(self, before: list[Row], after: list[Row], state: str | None = None) -> None:
        if after != before or state is not None:
            self._commit(after, state)

    def upsert(self, items: DataFrame) -> None:
        """Index items that are new or whose fields changed; others change nothing."""
        before = self.segments()
        self._write(before, self._upserted(before, items))

    def delete(self, ids: DataFrame) -> None:
        """Take the items of ids (id) out; ids that aren't indexed change nothing."""
        before = self.segments()
        live = self._last(before).filter("digest is not null")
        self._write(before, self._deleted(before, live.join(ids.select("id"), "id", "left_semi")))

    def refresh(self, items: DataFrame, state: str) -> None:
        """Make the index that of `items`. `state` marks what they come from: if it is the last version's, nothing is read."""
        before = self.segments()
        if before and before[0]["state"] == state:
            return
        after = self._upserted(before, items)
        if any(s["segment"] for s in before):  # a first write leaves nothing over
            after = self._deleted(after, self._last(after).filter("digest is not null").join(items.select("id"), "id", "left_anti"))
        self._write(before, after, state)

    def vacuum(self) -> None:
        """Delete the segments that the last version doesn't name; no reader of an earlier version may be at work."""
        named = {s["segment"] for s in self.segments()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind in ("entries", "postings"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            files = folder.getFileSystem(conf)
            for status in files.listStatus(folder) if files.exists(folder) else ():
                if status.getPath().getName() not in named:
                    files.delete(status.getPath(), True)
