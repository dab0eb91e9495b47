"""URL filters by a sort-merge range join.

A URL's canonical key is its host, lower-cased, labels in reverse order, each closed by a full
stop, then path and query: https://Www.example.com:80/a?b#c gives com.example.www./a?b. Scheme,
user, port and fragment don't count; an empty path is /. IPv4 addresses keep their order. A rule
is a prefix of keys: `example.com` covers a domain and what is under it, `example.com/a` the paths
of that host that begin with /a. All keys that begin with a prefix are neighbours in sorted order,
so a rule is an interval, and two rules are nested or apart.

Keys are cut into ranges by bounds taken from the keys themselves; a rule goes to every range that
its interval meets, which are the rules inside a range and, at its lower bound, only those nested
over it. In each range one sorted sweep keeps the stack of active rules: what isn't a prefix of
the next key is popped, so on the stack are all rules that cover a URL, the most specific on top.
That one decides. No rule table is broadcast, and a hot host is split like any other stretch.

Where no rule covers a URL, rule and action are null and the page is kept; so are null and empty
URLs, whose key is null. Of equal rules `block` goes before `allow`. Rules that are null, without
host or of another action are ignored. Rows of equal or null page_id each get a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
#: Keys read for the bounds, for each range.
SAMPLE = 20
_LAST = "\U0010ffff"

#: The rules of the query: domains of junk, with exceptions and exceptions of these.
RULES = [
    ("spam-farm.example.org", BLOCK),
    ("cheap-pills.example.com", BLOCK),
    ("adult-x.example.net", BLOCK),
    ("free-bets.example.com", BLOCK),
    ("casino-win.example.org", BLOCK),
    ("ads-track.example.org", BLOCK),
    ("spam-farm.example.org/en/", ALLOW),
    ("spam-farm.example.org/en/7", BLOCK),
    ("www.cheap-pills.example.com/de/", ALLOW),
    ("example.net", ALLOW),
    ("blog.ththan.example.net/es/", BLOCK),
    ("tionsh.example.net/fr/", BLOCK),
    ("tionsh.example.net/fr/1", ALLOW),
]

_HOST = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)"
_REST = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*([^#]*)"


def _host_key(url: Column) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.+$", ""))
    labels = F.split(host, r"\.")
    reversed_ = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), host).otherwise(F.array_join(F.reverse(labels), "."))
    return F.when(host != "", F.concat(reversed_, F.lit(".")))


def url_key(url: Column) -> Column:
    """Canonical key; null for a null URL or one without host."""
    rest = F.regexp_extract(url, _REST, 1)
    return F.concat(_host_key(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def rule_key(rule: Column) -> Column:
    """Prefix of the keys that the rule covers."""
    return F.concat(_host_key(rule), F.regexp_extract(rule, _REST, 1))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, action string")


def _bins(bounds: np.ndarray, keys: list[str]) -> np.ndarray:
    if not len(bounds) or not keys:
        return np.zeros(len(keys), np.int64)
    return np.searchsorted(bounds, np.array(keys, object), "right")


def verdicts(pages: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, url_key, n_rules, rule, action, keep) of every page: n_rules cover its URL, rule decides."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("key"))
    # bounds of the ranges: at most SAMPLE keys for each, those of the least hash
    some = urls.filter("key is not null").select("key", F.xxhash64("key", "page_id").alias("h")).orderBy("h", "key").limit(SAMPLE * ranges).select("key").toPandas()["key"]
    keys = sorted(some)
    bounds = np.array(sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else [], object)

    known = rules.select("rule", "action", rule_key(F.col("rule")).alias("key")).filter(F.col("key").isNotNull() & F.col("action").isin(BLOCK, ALLOW))
    known = known.groupBy("key").agg(F.min_by("rule", F.struct(F.when(F.col("action") == BLOCK, 0).otherwise(1), "rule")).alias("rule"), F.max("action").alias("action"))

    def place_url(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bins(bounds, b.column("key").to_pylist())), b.column("key"), pa.array(np.ones(b.num_rows, np.int32)), b.column("page_id"), pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.string())], ["bin", "key", "kind", "page_id", "rule", "action"])

    def place_rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            lo, hi = _bins(bounds, keys), _bins(bounds, [k + _LAST for k in keys])
            who = np.repeat(np.arange(len(keys)), hi - lo + 1)
            bin_ = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)]) if len(keys) else np.zeros(0, np.int64)
            part = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(bin_), part.column("key"), pa.array(np.zeros(len(who), np.int32)), pa.nulls(len(who), pa.int64()), part.column("rule"), part.column("action")], ["bin", "key", "kind", "page_id", "rule", "action"])

    schema = "bin long, key string, kind int, page_id long, rule string, action string"
    both = urls.filter("key is not null").mapInArrow(place_url, schema).unionByName(known.mapInArrow(place_rule, schema))
    swept = both.repartition(ranges, "bin").sortWithinPartitions("bin", "key", "kind").mapInArrow(sweep, "page_id long, url_key string, n_rules int, rule string, action string")
    nowhere = urls.filter("key is null").select("page_id", F.col("key").alias("url_key"), F.lit(0).alias("n_rules"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    return swept.unionByName(nowhere).withColumn("keep", F.coalesce(F.col("action") != BLOCK, F.lit(True)))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules and URLs in order of bin, key and kind; rules stay on the stack while they are prefixes."""
    stack: list[tuple[str, str, str]] = []
    now = None
    for b in batches:
        url, n_rules, rule, action = [], [], [], []
        for bin_, key, kind, r, a in zip(*(b.column(c).to_pylist() for c in ("bin", "key", "kind", "rule", "action"))):
            if bin_ != now:
                now, stack = bin_, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, r, a))
                continue
            url.append(key)
            n_rules.append(len(stack))
            rule.append(stack[-1][1] if stack else None)
            action.append(stack[-1][2] if stack else None)
        ids = b.column("page_id").filter(pa.array(np.asarray(b.column("kind")) == 1))
        yield pa.RecordBatch.from_arrays([ids, pa.array(url, pa.string()), pa.array(n_rules, pa.int32()), pa.array(rule, pa.string()), pa.array(action, pa.string())], ["page_id", "url_key", "n_rules", "rule", "action"])
