"""Operator 7: URL filters by pattern rules (native)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, table


@dataclass(frozen=True)
class Rule:
    """A rule on ``host + path``.  ``host``: the host itself and all its subdomains; ``path``: a prefix of
    the path.  ``pattern``: instead of both, a regular expression searched in host + path; ``literal`` is
    then a part of every match, delimited by other than letters and digits.  ``weight`` orders the rules
    that match; by default the length of host + path, 0 for a pattern."""

    verdict: str
    host: str = ""
    path: str = "/"
    pattern: str | None = None
    literal: str = ""
    weight: int | None = None

    @property
    def name(self) -> str:
        return self.host + self.path if self.pattern is None else self.pattern

    @property
    def rank(self) -> int:
        return self.weight if self.weight is not None else len(self.name) if self.pattern is None else 0

    @property
    def regex(self) -> str:
        if self.pattern is not None:
            return self.pattern
        return rf"^(?:[^/]*\.)?\Q{self.host}\E\Q{self.path}\E" if self.host else rf"^[^/]*\Q{self.path}\E"

    def tokens(self) -> list[str]:
        """Whole tokens that every URL which this rule fits must have."""
        if self.pattern is not None:
            return _TOKEN.findall(self.literal.lower())
        path = self.path.lower()
        whole = path if not path or not path[-1].isalnum() or not path[-1].isascii() else re.sub(r"[a-z0-9]+$", "", path)
        return _TOKEN.findall(self.host.lower() + "/" + whole)


_TOKEN = re.compile(r"[a-z0-9]+")
#: Up to this many rules become part of the plan (some 200 bytes each); more are joined by token.
MAX_INLINE_RULES = 2_000

#: Rules of the production query.
RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Words that in a host's label mark a kind of site that is not wanted, and in a path a kind of page.
HOST_WORDS = ("spam", "adult", "casino", "porn", "xxx", "malware", "phishing", "adserver", "doubleclick", "betting", "poker", "warez", "torrent", "escort", "viagra")
PATH_WORDS = ("adserver", "banners", "popunder", "clicktrack", "affiliate", "casino", "porn", "xxx", "warez")
#: The method's own rules, for URLs that no rule above fits.  Rules of structure have no literal word beyond what
#: every such URL must have: a host that is a bare IPv4 address.
OWN = (
    *(Rule("block", pattern=rf"^[^/]*(?:^|[.-]){w}(?:[.-]|$|/)", literal=w) for w in HOST_WORDS),
    *(Rule("block", pattern=rf"/{w}(?:/|$)", literal=w) for w in PATH_WORDS),
    Rule("block", pattern=r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?::[0-9]+)?(?:/|$)"),
)


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    after = F.when(F.locate("://", c) > 0, F.substring(c, F.locate("://", c) + 3, F.length(c)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, wanted: Iterable[str]) -> dict[str, int]:
    """In how many URLs each wanted token stands: at most one number for each token of the rules."""
    wanted = sorted(set(wanted))
    if not wanted:
        return {}
    hit = urls.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, wanted)))).alias("t"))
    return {r["t"]: r["n"] for r in hit.groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, rules: Iterable[Rule], own: Iterable[Rule] = (), url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``_host, _path, _rule, _verdict`` to every row of ``pages``.

    Each rule is indexed by the one of its literal tokens that is rarest among all URLs; a URL's own tokens
    fetch candidates, and only candidates run their regular expressions.  Among ``rules`` that fit, the
    longest wins and gives ``_rule`` and ``_verdict``; else the first of ``own`` that fits gives the verdict,
    else ``default``.  Rules up to MAX_INLINE_RULES are a map in the plan, so every row is judged where it is
    read; more rules are a table joined by token, hot tokens spread by AQE.  A rule without a whole literal
    token is a candidate of every URL.  Null and malformed URLs have empty parts and fit no host rule.
    Rows, repeated ones too, and all columns are kept; only columns named like the four new ones are replaced.
    An empty table gives no rows.
    """
    host, path = parts(url_col)
    rules, own = list(rules), list(own)
    both = [(r, True) for r in rules] + [(r, False) for r in own]
    tokens = F.array_distinct(F.split(F.lower(F.concat(host, F.lit("/"), path)), "[^a-z0-9]+"))
    n = token_counts(pages.select(tokens.alias("_tokens")), [t for r, _ in both for t in r.tokens()])
    by: dict[str, list[Column]] = {}
    table_rows = []
    for at, (r, first) in enumerate(both):
        token = min(r.tokens(), key=lambda t: (n.get(t, 0), t), default="")
        row = (int(first), r.rank, -at, r.name, r.verdict, r.regex)
        table_rows.append((token, *row))
        by.setdefault(token, []).append(F.struct(*[F.lit(v).alias(k) for k, v in zip(("given", "rank", "at", "name", "verdict", "regex"), row, strict=True)]))
    outputs = ("_host", "_path", "_rule", "_verdict")
    rows = pages.drop(*[c for c in pages.columns if c.lower() in outputs and c != url_col])
    if not both:
        return rows.withColumns({"_host": host, "_path": path, "_rule": F.lit(None).cast("string"), "_verdict": F.lit(default)})
    p = free_prefix(pages, "tokens", "fit", "best", "target", "url")
    wanted, fit, best, target = (p + c for c in ("tokens", "fit", "best", "target"))
    if len(both) <= MAX_INLINE_RULES:
        index = F.create_map(*[x for t, of in by.items() for x in (F.lit(t), F.array(*of))])
        out = rows.withColumns({target: F.concat(host, path), wanted: F.array_union(tokens, F.array(F.lit("")))})
        fetched = F.flatten(F.filter(F.transform(wanted, lambda t: F.element_at(index, t)), lambda x: x.isNotNull()))
        out = out.withColumn(fit, F.filter(fetched, lambda r: F.regexp(F.col(target), r["regex"])))
        out = out.withColumn(best, F.array_max(F.transform(fit, lambda r: F.struct(r["given"].alias("given"), r["rank"].alias("rank"), r["at"].alias("at"), r["name"].alias("name"), r["verdict"].alias("verdict")))))
    else:
        spark = pages.sparkSession
        index = spark.createDataFrame(table_rows, "_token string, given int, rank int, at int, name string, verdict string, regex string")
        urls = pages.select(F.col(url_col).alias("_url")).distinct().withColumn("_both", F.concat(*parts("_url")))
        urls = urls.withColumn("_token", F.explode(F.array_union(F.array_distinct(F.split(F.lower(F.concat(parts("_url")[0], F.lit("/"), parts("_url")[1])), "[^a-z0-9]+")), F.array(F.lit("")))))
        found = urls.join(index, "_token").where("regexp(_both, regex)").groupBy(F.col("_url").alias(p + "url")).agg(F.max(F.struct("given", "rank", "at", "name", "verdict")).alias(best))
        out = rows.join(found, F.col(url_col) == F.col(p + "url"), "left")
    rule = F.when(F.col(best)["given"] == 1, F.col(best)["name"])
    out = out.withColumns({"_host": host, "_path": path, "_rule": rule, "_verdict": F.coalesce(F.col(best)["verdict"], F.lit(default))})
    return out.drop(*[p + c for c in ("tokens", "fit", "best", "target", "url")])


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url with its host, path, rule and verdict."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, OWN)
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
