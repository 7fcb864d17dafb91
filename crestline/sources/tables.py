"""The stored model tables: one manifest names the files of every table, and a commit replaces it as a whole."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet scan whose zone-less timestamps are read as UTC instants.

    Changing the read schema (rather than casting) keeps time filters pushable.
    """
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema.fields):
        return df
    fields = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable)
        for f in df.schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


# Stored tables: columns as Spark DDL and the partition columns of the folder.
# A keyed table (``KEYS``) is also partitioned by ``bucket``, a remainder of its key.
TABLES: dict[str, tuple[str, list[str]]] = {
    "posts": (
        "post_id bigint, platform string, external_id string, market string, canonical_url string, content_type string, "
        "creator_username string, creator_external_id string, creator_followers bigint, creator_verified boolean, caption string, "
        "music_id string, music_title string, music_author string, published_at timestamp, duration_sec decimal(10,3), views bigint, "
        "views_metric string, likes bigint, comments bigint, shares bigint, saves bigint, first_seen_at timestamp, "
        "last_seen_at timestamp, known_at map<string,timestamp>, tier string, availability string, vph decimal(14,2), vph_kind string, velocity_confidence string, "
        "trend_score int, rising_score int, trend_state string, trend_state_since timestamp, scored_at timestamp, scoring_version int, "
        "next_refresh_at timestamp, paid_refresh_count int, score_components array<struct<score:string,component:string,"
        "available:boolean,raw:double,z:double,normalized:double,weight_configured:double,weight_used:double>>",
        ["market", "platform"],
    ),
    "post_snapshots": (
        "post_id bigint, observed_at timestamp, views bigint, likes bigint, comments bigint, shares bigint, saves bigint, "
        "views_metric string, source string, provider_job_id bigint, observed_date date",
        ["observed_date"],
    ),
    # The velocity walk of every post so far, and its newest stored snapshot.
    "post_folds": (
        "post_id bigint, published_at timestamp, fold struct<n:int,t0:bigint,v0:bigint,t1:bigint,v1:bigint,t2:bigint,v2:bigint,fell:boolean,"
        "last_t:bigint,last_v:bigint>, newest struct<observed_at:timestamp,views:bigint,likes:bigint,comments:bigint,shares:bigint,saves:bigint>",
        [],
    ),
    "hashtags": (
        "hashtag_id bigint, name string, is_generic boolean, is_blocked boolean, first_seen_at timestamp, last_seen_at timestamp", [],
    ),
    "post_hashtags": ("post_id bigint, hashtag_id bigint, position int", []),
    "post_discoveries": (
        "post_id bigint, provider_job_id bigint, hashtag_id bigint, query_text string, rank_in_results int, observed_at timestamp", [],
    ),
    "post_categories": ("post_id bigint, category string, confidence double, source string", []),
    "hashtag_categories": ("hashtag_id bigint, category string, confidence double, source string", []),
    "tracked_hashtags": (
        "tracked_id bigint, hashtag_id bigint, platform string, market string, tier string, source string, trend_state string, "
        "trend_state_since timestamp, momentum decimal(6,5), next_due_at timestamp, last_scanned_at timestamp, scans_total int, "
        "probes_in_tier int, consecutive_empty_scans int, tier_changed_at timestamp",
        [],
    ),
    "hashtag_daily_stats": (
        "date date, platform string, market string, hashtag_id bigint, posts_seen bigint, watch_posts bigint, viral_posts bigint, "
        "breakout_posts bigint, distinct_creators bigint, viral_views_sum bigint, median_vph decimal(14,2), scans bigint, "
        "trend_state string, momentum decimal(6,5)",
        ["date"],
    ),
    "hashtag_cooccurrence_daily": (
        "date date, platform string, market string, tag_a bigint, tag_b bigint, posts bigint, viral_posts bigint, views_sum bigint", ["date"],
    ),
    "hashtag_tier_events": ("tracked_id bigint, from_tier string, to_tier string, reason string, at timestamp", []),
    "scoring_baselines": (
        "platform string, market string, metric string, computed_at timestamp, n int, median decimal(18,4), mad decimal(18,4)", [],
    ),
    "provider_jobs": (
        "job_id bigint, run_id bigint, provider string, platform string, market string, job_type string, status string, submitted_at timestamp, "
        "queries array<struct<tracked_id:bigint,hashtag_id:bigint,query:string>>, requested array<string>, records_returned bigint, "
        "records_quarantined bigint, ingested_at timestamp, cost_est_usd decimal(12,6)",
        [],
    ),
    "collection_runs": ("run_id bigint, kind string, platform string, market string, status string, planned_at timestamp", []),
    # Records whose job is not in the ledger yet.
    "held_items": ("provider string, platform string, provider_job_id bigint, payload string, observed_at timestamp, rank_in_results int", []),
    "daily_reports": ("report_date string, market string, generated_at timestamp, delivered_at timestamp, document string", []),
    "result_views": ("view_id string, kind string, rank int, post_id bigint, created_at timestamp, expires_at timestamp", []),
    "error_events": ("at timestamp, scope string, severity string, message string", []),
    "quarantined_items": (
        "provider string, platform string, provider_job_id bigint, payload string, error string, created_at timestamp", [],
    ),
}


# Keyed tables take upserts; their keys are hashes or running numbers, so remainders spread evenly.
KEYS = {"posts": "post_id", "hashtags": "hashtag_id", "post_folds": "post_id", "provider_jobs": "job_id"}
BUCKETS = 16
# Keys of pending upserts are broadcast up to this count; beyond it the read joins by shuffle. A broadcast passes
# through the driver, and a batch makes several.
DELTA_KEYS = 1 << 16


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], ddl) for n, (ddl, _) in TABLES.items()}


def bucket_of(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")


class Conflict(RuntimeError):
    """Another writer committed first; read again and retry."""


class Store:
    """Tables as parquet folders below one manifest.

    Every write lands in a folder of its own and is invisible until a manifest
    that lists it is put in place by a rename that fails if that version exists.
    So a batch that writes several tables becomes visible as a whole or not at
    all, two writers cannot both win, and a reader that pinned a manifest keeps
    seeing its files until they are swept. The manifest lists partition folders:
    replacing or dropping partitions moves no data.

    Upserts of keyed tables append whole rows; the newest row of a key counts
    (merge on read), until ``compact`` folds them into the base.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self._pinned = spark, root.rstrip("/"), version

    # --- manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """Of the pinned or newest version: its number, per table the folders of ``base`` and ``delta``, and notes."""
        known = self.versions() if self._pinned is None else [self._pinned]
        if not known:
            return {"version": -1, "tables": {}}
        fs, p = self._fs(f"{self.root}/_manifests/{known[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pin(self, version: int | None = None) -> Store:
        """The same store, read as of one manifest."""
        return Store(self.spark, self.root, self.manifest()["version"] if version is None else version)

    def _put(self, manifest: dict) -> None:
        """Put a manifest in place, unless its version exists: write beside it, then rename without overwriting."""
        target = f"{self.root}/_manifests/{manifest['version']:012d}.json"
        fs, tmp = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, self._fs(target)[1], options)
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.root} exists") from None
            raise

    # --- reading

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The table; of a keyed one, the newest row of every key.

        Name the ``columns`` where a keyed table is wide: the newest rows are found by whole rows otherwise.
        """
        return _view(self, name, self.manifest(), columns)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a keyed table whose key is in ``keys`` (a stored table), read from their buckets only."""
        return _lookup(self, name, keys, self.manifest())

    # --- writing

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Writes that become visible together at the end of the block, or not at all."""
        tx = Transaction(self)
        yield tx
        if not tx.dropped:
            tx.commit()

    def append(self, name: str, df: DataFrame) -> None:
        with self.transaction() as tx:
            tx.append(name, df)

    def rewrite(self, name: str, df: DataFrame) -> None:
        with self.transaction() as tx:
            tx.rewrite(name, df)

    def overwrite_partitions(self, name: str, df: DataFrame) -> None:
        """Replace only the partitions present in ``df`` (idempotent reruns)."""
        with self.transaction() as tx:
            tx.overwrite_partitions(name, df)

    def upsert(self, name: str, df: DataFrame) -> None:
        with self.transaction() as tx:
            tx.upsert(name, df)

    def compact(self, name: str) -> None:
        """Fold the upserts of a keyed table into its base."""
        with self.transaction() as tx:
            tx.rewrite(name, tx.read(name))

    # --- sweeping

    def unreferenced(self, keep: int = 1) -> list[str]:
        """Commit folders that none of the last ``keep`` manifests lists, relative to the root."""
        used: set[str] = set()
        for v in self._kept(keep):
            for name, sets in self.pin(v).manifest()["tables"].items():
                used.update(f"{name}/{folder.split('/')[0]}" for folder in (*sets["base"], *sets["delta"]))
        found = []
        for name in TABLES:
            fs, p = self._fs(f"{self.root}/{name}")
            if fs.exists(p):
                found += [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p)]
        return sorted(f for f in found if f not in used)

    def sweep(self, keep: int = 1, older_than_s: float = 86_400) -> list[str]:
        """Delete unreferenced folders that are old enough not to belong to a running writer, and manifests before the last ``keep``."""
        gone = []
        for folder in self.unreferenced(keep):
            fs, p = self._fs(f"{self.root}/{folder}")
            if fs.getFileStatus(p).getModificationTime() / 1000 <= time.time() - older_than_s:
                fs.delete(p, True)
                gone.append(folder)
        stay = self._kept(keep)
        for v in self.versions():
            if v not in stay:
                fs, p = self._fs(f"{self.root}/_manifests/{v:012d}.json")
                fs.delete(p, False)
        return gone

    def _kept(self, keep: int) -> set[int]:
        """The last ``keep`` versions and those that the notes of the newest one name."""
        noted = {n[k] for n in self.manifest().get("notes", {}).values() for k in ("base", "made") if k in n}
        known = self.versions()
        return set(known[-keep:]) | (noted & set(known))


class Transaction:
    """Pending writes over one pinned manifest; ``read`` sees the pinned state and what was written since."""

    def __init__(self, store: Store):
        self.store, self.spark, self.dropped = store, store.spark, False
        now = store.manifest()
        self.before = now["version"]
        tables = {n: {k: list(v) for k, v in t.items()} for n, t in now["tables"].items()}
        self.next = {"version": self.before + 1, "tables": tables, "notes": dict(now.get("notes", {}))}

    def read(self, name: str) -> DataFrame:
        return _view(self.store, name, self.next)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        return _lookup(self.store, name, keys, self.next)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to a table; the rows as they are stored."""
        return self._add(name, "base", df)

    def rewrite(self, name: str, df: DataFrame) -> None:
        self.next["tables"][name] = {"base": self._write(name, df), "delta": []}

    def overwrite_partitions(self, name: str, df: DataFrame) -> None:
        new = self._write(name, df)
        replaced = {_partition(f) for f in new}
        sets = self._sets(name)
        sets["base"] = [f for f in sets["base"] if _partition(f) not in replaced] + new

    def upsert(self, name: str, df: DataFrame) -> DataFrame:
        """Whole rows that replace those of equal key, as they are stored; as many rows are written as there are keys in ``df``."""
        if name not in KEYS:
            raise ValueError(f"{name} has no key")
        return self._add(name, "delta", df)

    def drop_partitions(self, name: str, doomed: Callable[[dict[str, str]], bool]) -> list[str]:
        """Take partitions out of the table by their values; no file is read or moved."""
        sets = self._sets(name)
        out = [f for f in sets["base"] if doomed(dict(x.split("=", 1) for x in _partition(f).split("/") if x))]
        sets["base"] = [f for f in sets["base"] if f not in out]
        return out

    def put_if_absent(self, name: str, df: DataFrame, key: list[str]) -> bool:
        """Append ``df`` (rows of one key) unless the table has that key; the version check decides between two writers."""
        if not self.read(name).join(df.select(*key).distinct(), key, "left_semi").isEmpty():
            return False
        self.append(name, df)
        return True

    def note(self, name: str, value: dict | None = None) -> dict | None:
        """A note kept in the manifests; the versions it names as ``base`` and ``made`` are kept from being swept."""
        if value is not None:
            self.next["notes"][name] = value
        return self.next["notes"].get(name)

    def restore(self, names: tuple[str, ...], version: int, made: int) -> bool:
        """Put tables back to the files of ``version``, as if the commit ``made`` had not been; upserts after it stay.

        False, and nothing changes, if one of those manifests is gone or a table was rewritten or appended to since.
        """
        known = set(self.store.versions())
        if made not in known or (version >= 0 and version not in known):
            return False
        none = {"base": [], "delta": []}
        left = self.store.pin(made).manifest()["tables"]
        old = self.store.pin(version).manifest()["tables"] if version >= 0 else {}
        later = {}
        for name in names:
            now, was = self._sets(name), left.get(name, none)
            if now["base"] != was["base"] or now["delta"][: len(was["delta"])] != was["delta"]:
                return False
            later[name] = now["delta"][len(was["delta"]) :]
        for name in names:
            sets = old.get(name, none)
            self.next["tables"][name] = {"base": list(sets["base"]), "delta": [*sets["delta"], *later[name]]}
        return True

    def drop(self) -> None:
        """Give the pending writes up; the block ends without a commit."""
        self.dropped = True

    def commit(self) -> None:
        self.store._put(self.next)

    def _sets(self, name: str) -> dict[str, list[str]]:
        return self.next["tables"].setdefault(name, {"base": [], "delta": []})

    def _add(self, name: str, kind: str, df: DataFrame) -> DataFrame:
        new = self._write(name, df)
        self._sets(name)[kind].extend(new)
        return _scan(self.store, name, new).drop("commit", "bucket")

    def _write(self, name: str, df: DataFrame) -> list[str]:
        """Write ``df`` into a folder of its own; its partition folders, relative to the table."""
        ddl, parts = TABLES[name]
        commit = f"commit={self.next['version']:012d}-{uuid.uuid4().hex[:12]}"
        rows = shaped(df, ddl)
        if name in KEYS:
            # One file per bucket, more where a bucket is large; sorted, so that key ranges prune row groups.
            rows = rows.withColumn("bucket", bucket_of(KEYS[name])).hint("rebalance", "bucket").sortWithinPartitions(*parts, "bucket", KEYS[name])
            parts = [*parts, "bucket"]
        path = f"{self.store.root}/{name}/{commit}"
        rows.write.partitionBy(*parts).parquet(path)
        fs, p = self.store._fs(path)
        level = [(commit, p)]
        for _ in parts:
            level = [(f"{f}/{s.getPath().getName()}", s.getPath()) for f, q in level for s in fs.listStatus(q) if s.isDirectory() and "=" in s.getPath().getName()]
        return [f for f, _ in level]


def _partition(folder: str) -> str:
    return folder.partition("/")[2]


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """Columns and types of a table; the snapshot date is derived."""
    have = set(df.columns)
    cols = []
    for f in T.StructType.fromDDL(ddl).fields:
        if f.name == "observed_date" and "observed_date" not in have:
            cols.append(F.to_date("observed_at").alias("observed_date"))
        elif f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _scan(store: Store, name: str, folders: list[str]) -> DataFrame:
    ddl, _ = TABLES[name]
    more = ", commit string" + (", bucket int" if name in KEYS else "")
    if not folders:
        return store.spark.createDataFrame([], ddl + more)
    base = f"{store.root}/{name}"
    return store.spark.read.schema(ddl + more).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])


def _view(store: Store, name: str, manifest: dict, columns: list[str] | None = None) -> DataFrame:
    sets = manifest["tables"].get(name, {"base": [], "delta": []})
    columns = columns or T.StructType.fromDDL(TABLES[name][0]).fieldNames()
    base = _scan(store, name, sets["base"])
    if not sets["delta"]:
        return base.select(*columns)
    return _newest(base, _scan(store, name, sets["delta"]), KEYS[name], columns)


def _newest(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The newest row of every key; only the upserts are grouped, the base streams past their keys."""
    newest = delta.groupBy(key).agg(F.max_by(F.struct(*columns), "commit").alias("r")).select("r.*")
    keys = delta.select(key).distinct()
    # The number of rows is a footer read; it bounds the keys.
    keys = _side(keys, delta.count())
    return base.join(keys, key, "left_anti").select(*columns).unionByName(newest)


def _side(keys: DataFrame, n: int) -> DataFrame:
    """``n`` keys as the side of a join: broadcast if few, else shuffled, however small their statistics look."""
    return F.broadcast(keys) if n <= DELTA_KEYS else keys.hint("merge")


def _lookup(store: Store, name: str, keys: DataFrame, manifest: dict) -> DataFrame:
    sets = manifest["tables"].get(name, {"base": [], "delta": []})
    key, columns = KEYS[name], T.StructType.fromDDL(TABLES[name][0]).fieldNames()
    near = keys.select(key).distinct()
    span = near.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.collect_set(bucket_of(key)).alias("buckets"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return store.spark.createDataFrame([], TABLES[name][0])
    near = _side(near, span["n"])
    pruned = F.col("bucket").isin(span["buckets"]) & F.col(key).between(span["lo"], span["hi"])
    base, delta = (_scan(store, name, sets[k]).where(pruned).join(near, key, "left_semi") for k in ("base", "delta"))
    if not sets["delta"]:
        return base.select(*columns)
    return base.withColumn("commit", F.lit("")).unionByName(delta).groupBy(key).agg(F.max_by(F.struct(*columns), "commit").alias("r")).select("r.*")
