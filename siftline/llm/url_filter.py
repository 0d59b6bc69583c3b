"""URL filters by a temporal list join.

A list's dated entries become validity intervals: an entry holds from its date until the next entry for the same
pattern. Every capture is looked up under each pattern that can match its URL, as of the time it was fetched; of
the entries active then the most specific decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lists of up to this many intervals go to every executor (some 20 MB); longer ones are joined by a shuffle.
BROADCAST_ENTRIES = 200_000
#: How specific a host entry and a prefix entry are at least; a domain entry has its number of labels.
HOST_RANK, PREFIX_RANK = 1_000_000, 2_000_000
#: An IPv4 address, which is one label, as an IPv6 address in its brackets is.
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of dated ``entries(kind, pattern, action, listed_at)``.

    kind: domain (the host and all below it), host (that host only) or prefix (host and path). An action
    "remove" ends what held before. Of entries for a pattern with one date the last action by name holds.
    Entries with a null in any of these columns are left out.
    """
    dated = entries.where("kind is not null and pattern is not null and action is not null and listed_at is not null")
    key = F.concat_ws(":", F.lower("kind"), F.regexp_replace(F.lower("pattern"), r"/+$", ""))
    dated = dated.select(key.alias("pattern"), F.lower("action").alias("action"), F.col("listed_at").alias("valid_from")).distinct()
    following = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from", "action"))
    return dated.withColumn("valid_to", following).where("action <> 'remove' and (valid_to is null or valid_to > valid_from)")


def host_of(url: F.Column) -> F.Column:
    """The host in lower case, without user, port or a final dot, an IPv6 address with its brackets; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]\s]+)", 1)), r"\.$", "")


def _of_depths(depths: list[int], most: F.Column) -> F.Column:
    """Those of the depths that are at most ``most``."""
    return F.filter(F.array(*map(F.lit, sorted(depths))).cast("array<int>"), lambda i: i <= most)


def _keys(host: F.Column, url: F.Column, label_depths: list[int], part_depths: list[int]) -> F.Column:
    """(pattern, how specific) of everything that can match a list whose entries have those depths, broad patterns first."""
    labels = F.when(host.startswith("[") | host.rlike(f"^{IPV4}$"), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    above = _of_depths(label_depths, n)
    domains = F.transform(above, lambda i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, n - i + 1, i), ".")).alias("pattern"), i.alias("rank")))
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/*([^?#]*)", 1)
    parts = F.filter(F.split(F.lower(path), "/+"), lambda p: p != "")
    prefixes = F.transform(_of_depths(part_depths, F.size(parts)), lambda i: F.struct(F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"), (i + PREFIX_RANK).cast("int").alias("rank")))
    return F.concat(domains, F.array(F.struct(F.concat(F.lit("host:"), host).alias("pattern"), F.lit(HOST_RANK).alias("rank"))), prefixes)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, url, fetched_at, host, n_active, pattern, action) for each row of ``captures(capture_id, url, fetched_at)``.

    n_active counts the list entries that match the URL and held when it was fetched; pattern and action are the
    most specific one's (prefix over host over domain, the longer over the shorter), action "allow" where none
    holds. A null or malformed URL has no host and, like a null time, no active entry. Repeated rows each come
    back. An empty list allows all; an empty table gives an empty table. Other columns, of any name, are ignored.

    Hosts and paths are compared in lower case and as they are written: a percent code or a name in punycode is not the
    character it stands for. An IP address is one label, so a domain entry meets the whole address only. URLs of any
    length are read whole.
    """
    listed = validity(entries)
    # the depths of the list's entries, a few dozen numbers, say what to look up
    deep = lambda kind, mark: F.collect_set(F.when(F.col("pattern").startswith(f"{kind}:"), mark))
    labels = F.when(F.col("pattern").startswith("domain:[") | F.col("pattern").rlike(f"^domain:{IPV4}$"), 1).otherwise(F.size(F.split("pattern", r"\.")))
    entries_, labels, parts = listed.agg(F.count("*"), deep("domain", labels), deep("prefix", F.size(F.split("pattern", "/")) - 1)).first()
    listed = F.broadcast(listed) if entries_ <= BROADCAST_ENTRIES else listed
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    keyed = captures.select("capture_id", "url", "fetched_at", host.alias("host")).withColumn("keys", _keys(F.col("host"), F.coalesce("url", F.lit("")), labels, parts))
    each = keyed.select("capture_id", "url", "fetched_at", "host", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    each = each.select("capture_id", "url", "fetched_at", "host", "n_keys", F.col("key.pattern").alias("looked_up"), F.col("key.rank").alias("rank"))
    active = (each["looked_up"] == listed["pattern"]) & (each["host"] != "") & (each["fetched_at"] >= listed["valid_from"]) & (listed["valid_to"].isNull() | (each["fetched_at"] < listed["valid_to"]))
    found = each.join(listed, active, "left")
    decided = found.groupBy("capture_id", "url", "fetched_at", "host", "n_keys").agg(
        F.count("*").alias("rows"), F.count("action").alias("hits"), F.max(F.when(F.col("action").isNotNull(), F.struct("rank", "pattern", "action"))).alias("last")
    )
    copies = (F.col("rows") / F.col("n_keys")).cast("int")
    return decided.select(
        "capture_id",
        "url",
        "fetched_at",
        "host",
        (F.col("hits") / copies).cast("long").alias("n_active"),
        F.col("last.pattern").alias("pattern"),
        F.coalesce("last.action", F.lit("allow")).alias("action"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")
