"""URL filters by rules and empirical-Bayes host reputation.

Labelled pages give each host good and bad outcomes. A host's rate has a beta prior centred on its registered domain's rate, the
domain's on its suffix's, the suffix's on the rate of all; each level's prior strength is fitted to how far groups
of that level scatter around their parents (the moment estimate of a beta-binomial). A page that no rule decides is allowed if
the lower bound of its host's posterior reaches a threshold; a host without labelled pages has its prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, settled

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Standard deviations below the posterior mean: a one-sided bound of 95 %.
Z = 1.645
THRESHOLD = 0.5


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _shrunk(groups: DataFrame, parent: DataFrame | None, on: str | None) -> DataFrame:
    """``groups`` (with n, good) and their prior mean ``prior``, strength ``strength`` and posterior mean ``mean``."""
    if parent is None:
        total = groups.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
        groups = groups.withColumn("prior", F.lit(total.first()["prior"]))
    else:
        groups = groups.join(parent.select(on, F.col("mean").alias("prior")), on)
    spread = F.col("prior") * (1 - F.col("prior"))
    got = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("prior")) ** 2).alias("seen"), F.sum(spread).alias("one"), F.sum((F.col("n") - 1) * spread).alias("more")
    ).first()
    within = (got["seen"] - got["one"]) / got["more"] if got["more"] else 0.0
    strength = 1 / min(max(within, 0.001), 0.5) - 1
    mean = (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)
    return groups.withColumn("strength", F.lit(strength)).withColumn("mean", mean)


def host_reputation(hosts: DataFrame) -> DataFrame:
    """host, mean and bound for each row of ``hosts`` (host, n labelled pages, good ones)."""
    named = F.split("host", r"\.")
    hosts = settled(
        hosts.select(
            "host", "n", "good", F.element_at(named, -1).alias("suffix"),
            F.when(F.size(named) > 1, F.concat_ws(".", F.element_at(named, -2), F.element_at(named, -1))).otherwise(F.col("host")).alias("domain"),
        )
    )
    domains = settled(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = settled(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = _shrunk(suffixes, None, None)
    domains = _shrunk(domains, suffixes, "suffix")
    hosts = _shrunk(hosts, domains, "domain")
    a = F.col("good") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("good") + F.col("strength") * (1 - F.col("prior"))
    bound = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", F.col("mean").alias("mean"), bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url).

    ``outcomes`` (page_no, good 0/1) are labelled outcomes of pages by the number that ends a url's path. The longest
    fitting rule decides; otherwise the verdict is allow where the host's posterior bound reaches ``threshold``. A null url, or one
    without ``://``, has an empty host and path and the reputation of the empty host. Repeated rows are judged each.
    Null labels and numbers without a label count for nothing; several labels of one number count once, by their mean rounded up.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    rows = rows.withColumn("page_no", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)(?:\\.[a-z]+)?/?$', 1) AS bigint)"))
    labelled = outcomes.filter("page_no is not null and good is not null").groupBy("page_no").agg(F.ceil(F.avg("good")).alias("good"))
    rows = rows.withColumn("salt", F.xxhash64("page_id", "path"))
    seen = rows.filter("page_no is not null").join(labelled, "page_no", "left").unionByName(rows.filter("page_no is null").withColumn("good", F.lit(None).cast("bigint")))
    rows = settled(seen)
    rows = rows.withColumn("salt", F.shiftright("salt", 64 - hash_bits(rows.count())))
    # a host that very many pages share is counted and looked up in shares
    shares = rows.groupBy("host", "salt").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = shares.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    named = shares.select("host", "salt").join(host_reputation(hosts), "host")
    name, decided = matched_rule(rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    out = rows.drop("good").join(named, ["host", "salt"])
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(decided, own).alias("verdict"))


ORACLE_SQL = r"""
    WITH raw AS (
        SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']), {'h': '', 'p': ''}) AS u FROM pages),
    p AS (
        SELECT page_id, translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.p AS path,
            try_cast(regexp_extract(u.p, '([0-9]+)(?:\.[a-z]+)?/?$', 1) AS BIGINT) AS page_no
        FROM raw),
    l AS (SELECT doc_id AS page_no, ceil(avg(quality))::BIGINT AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    h AS (
        SELECT host, count(l.good) AS n, coalesce(sum(l.good), 0)::BIGINT AS good, list_last(string_split(host, '.')) AS suffix,
            CASE WHEN contains(host, '.') THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS domain
        FROM p LEFT JOIN l USING (page_no) GROUP BY host),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
    s1 AS (SELECT *, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s) AS prior FROM s),
    sm AS (SELECT *, (SELECT 1 / least(greatest(coalesce((sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001), 0.5) - 1
        FROM s1 WHERE n > 0) AS strength FROM s1),
    d1 AS (SELECT d.*, (sm.good + strength * prior) / (sm.n + strength) AS prior FROM d JOIN sm USING (suffix)),
    dm AS (SELECT *, (SELECT 1 / least(greatest(coalesce((sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001), 0.5) - 1
        FROM d1 WHERE n > 0) AS strength FROM d1),
    h1 AS (SELECT h.*, (dm.good + strength * prior) / (dm.n + strength) AS prior FROM h JOIN dm USING (domain)),
    hm AS (SELECT *, (SELECT 1 / least(greatest(coalesce((sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001), 0.5) - 1
        FROM h1 WHERE n > 0) AS strength FROM h1),
    ab AS (SELECT host, good + strength * prior AS a, n - good + strength * (1 - prior) AS b FROM hm),
    v AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.5 THEN 'allow' ELSE 'block' END AS own FROM ab),
    r AS (
        SELECT page_id, host, path, own, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM p JOIN v USING (host))
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE own END AS verdict FROM r
"""
