"""Text as Column expressions: cleaning, tokenizing, stop words, stemming, term weights."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..base import Params, Transformer, transformer

# English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


class _Text(Transformer):
    """Rewrites string columns; ``expr`` is the rewrite."""

    defaults = {"columns": None}

    def expr(self, c: Column) -> Column:
        raise NotImplementedError

    def fit(self, df, y=None):
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = self.columns or [c for c, t in df.dtypes if t == "string"]
        return df.withColumns({c: self.expr(F.col(c)) for c in ([names] if isinstance(names, str) else names)})


@F.pandas_udf(T.StringType())
def _no_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@transformer
class TextCleaner(_Text):
    """In this order: html, urls, emails, case, accents, numbers, punctuation, special characters, white space, short words."""

    defaults = {"lowercase": True, "remove_punctuation": False, "remove_numbers": False, "remove_whitespace": True, "remove_html": True, "remove_urls": True, "remove_emails": True, "remove_special_chars": False, "remove_accents": False, "min_word_length": 0, "columns": None}

    def expr(self, c):
        if self.remove_html:
            c = F.regexp_replace(c, r"<[^>]+>", " ")
        if self.remove_urls:
            c = F.regexp_replace(c, r"(?:https?://|www\.)\S+", " ")
        if self.remove_emails:
            c = F.regexp_replace(c, r"\S+@\S+\.\S+", " ")
        if self.lowercase:
            c = F.lower(c)
        if self.remove_accents:
            c = _no_accents(c)
        if self.remove_numbers:
            c = F.regexp_replace(c, r"\d+", " ")
        if self.remove_punctuation:
            c = F.regexp_replace(c, r"\p{Punct}", " ")
        if self.remove_special_chars:
            c = F.regexp_replace(c, r"[^A-Za-z0-9\s]", " ")
        if self.remove_whitespace:
            c = F.trim(F.regexp_replace(c, r"\s+", " "))
        if self.min_word_length > 1:
            c = F.array_join(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= self.min_word_length), " ")
        return c


@transformer
class StopWordRemover(_Text):
    defaults = {"stop_words": "english", "case_sensitive": False, "columns": None}

    def expr(self, c):
        words = STOP_WORDS if self.stop_words == "english" else list(self.stop_words)
        stop = F.array(*[F.lit(w if self.case_sensitive else w.lower()) for w in words])
        return F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.array_contains(stop, w if self.case_sensitive else F.lower(w))), " ")


@transformer
class TextNormalizer(_Text):
    """Unicode form, lower case, white space."""

    defaults = {"form": "NFKC", "lowercase": True, "strip": True, "collapse_whitespace": True, "columns": None}

    def expr(self, c):
        form = self.form

        @F.pandas_udf("string")
        def normal(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

        c = normal(c) if form else c
        c = F.lower(c) if self.lowercase else c
        c = F.regexp_replace(c, r"\s+", " ") if self.collapse_whitespace else c
        return F.trim(c) if self.strip else c


def stem(w: Column) -> Column:
    """Common English endings, longest first, where enough of the word remains."""
    rules = ((r"(?<=.{3})(ization|ational|fulness|ousness|iveness)$", ""), (r"sses$", "ss"), (r"ies$", "i"), (r"(?<=[^su])s$", ""), (r"(?<=.{2}[aeiouy].{0,9})(eed)$", "ee"), (r"(?<=[aeiouy][^aeiouy]{1,4})(?:ed|ing)$", ""), (r"(?<=.{3})(?:ement|ment|ness|tion|able|ible)$", ""), (r"(?<=[aeiouy][^aeiouy]{1,4})y$", "i"))
    for pattern, to in rules:
        w = F.regexp_replace(w, pattern, to)
    return w


@transformer
class Stemmer(_Text):
    defaults = {"lowercase": True, "columns": None}

    def expr(self, c):
        c = F.lower(c) if self.lowercase else c
        return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), stem), " ")


class BaseTokenizer(Params):
    def tokens(self, c: Column) -> Column:
        raise NotImplementedError

    def __call__(self, c) -> Column:
        return self.tokens(F.col(c) if isinstance(c, str) else c)

    def transform(self, df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
        return df.withColumn(out, self(column))


class WordTokenizer(BaseTokenizer):
    defaults = {"lowercase": True, "remove_punctuation": True, "min_length": 1}

    def tokens(self, c):
        t = F.regexp_extract_all(F.lower(c) if self.lowercase else c, F.lit(r"(?U)\w+"), F.lit(0))
        return F.filter(t, lambda w: F.length(w) >= self.min_length) if self.min_length > 1 else t


class WhitespaceTokenizer(BaseTokenizer):
    defaults = {"lowercase": False}

    def tokens(self, c):
        return F.regexp_extract_all(F.lower(c) if self.lowercase else c, F.lit(r"\S+"), F.lit(0))


class RegexTokenizer(BaseTokenizer):
    defaults = {"pattern": r"\w+", "gaps": False, "lowercase": True}

    def tokens(self, c):
        c = F.lower(c) if self.lowercase else c
        return F.filter(F.split(c, self.pattern), lambda w: w != "") if self.gaps else F.regexp_extract_all(c, F.lit(self.pattern), F.lit(0))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Runs of n tokens, joined: shifted copies of the array are zipped, so it is built n times and not once a run."""
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, 1, count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, count), lambda a, b: F.concat(a, F.lit(sep), b))
    return out


class NGramTokenizer(BaseTokenizer):
    defaults = {"n": 2, "max_n": None, "level": "word", "lowercase": True}

    def tokens(self, c):
        c = F.lower(c) if self.lowercase else c
        base = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)) if self.level == "word" else F.filter(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda w: w != "")
        return F.concat(*[ngrams(base, k, " " if self.level == "word" else "") for k in range(self.n, (self.max_n or self.n) + 1)])


class SentenceTokenizer(BaseTokenizer):
    """Splits after . ! ? before an upper-case letter, but not after an abbreviation."""

    defaults = {"abbreviations": None}

    def tokens(self, c):
        short = self.abbreviations or ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "vs", "etc", "Inc", "Ltd", "Co")
        behind = "".join(rf"(?<!\b{a}\.)" for a in short)
        return F.filter(F.split(F.trim(c), rf"(?<=[.!?]){behind}\s+(?=\p{{Lu}})"), lambda s: s != "")


class TreebankTokenizer(BaseTokenizer):
    """Splits contractions and punctuation from words."""

    def tokens(self, c):
        c = F.regexp_replace(c, r"(?i)n't\b", " n't")
        c = F.regexp_replace(c, r"(?i)('(?:ll|re|ve|s|m|d))\b", " $1")
        c = F.regexp_replace(c, r"([.,!?;:()\[\]{}\"])", " $1 ")
        return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


class CountVectorizer(Params):
    """A vocabulary from document frequencies, ordered by falling frequency, then token; cut only by ``max_features``
    or ``max_vocabulary``.

    ``transform`` adds ``counts``, a map from token to count in the document; terms never become a dense matrix.
    """

    defaults = {"tokenizer": None, "max_features": None, "min_df": 1, "max_df": 1.0, "binary": False, "lowercase": True, "stop_words": None, "ngram_range": (1, 1), "max_vocabulary": None}

    def _tokens(self, column: str) -> Column:
        t = (self.tokenizer or WordTokenizer(self.lowercase))(column)
        if self.stop_words:
            stop = F.array(*map(F.lit, STOP_WORDS if self.stop_words == "english" else self.stop_words))
            t = F.filter(t, lambda w: ~F.array_contains(stop, w))
        lo, hi = self.ngram_range
        return F.concat(*[t if n == 1 else ngrams(t, n) for n in range(lo, hi + 1)])

    def fit(self, df: DataFrame, column: str):
        self.column = column
        self.n_docs = df.count()
        least = self.min_df if self.min_df >= 1 and not isinstance(self.min_df, float) else self.min_df * self.n_docs
        most = self.max_df if isinstance(self.max_df, int) else self.max_df * self.n_docs
        freq = df.select(F.explode(F.array_distinct(self._tokens(column))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        freq = freq.where((F.col("df") >= least) & (F.col("df") <= most)).orderBy(F.desc("df"), "token")
        most = self.max_features or self.max_vocabulary
        self.vocabulary = freq.limit(most) if most else freq
        return self

    def terms(self, df: DataFrame, id_col: str) -> DataFrame:
        """``id, token, tf`` in long form, joined with the vocabulary."""
        rows = df.select(id_col, F.explode(self._tokens(self.column)).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
        rows = rows.join(self.vocabulary, "token")
        return rows.withColumn("tf", F.lit(1)) if self.binary else rows

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        return self.terms(df, id_col).groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "tf")))).alias("counts"))


class TfidfTransformer(Params):
    """Weights ``id, token, tf, df`` rows."""

    defaults = {"norm": "l2", "use_idf": True, "smooth_idf": True, "sublinear_tf": False}

    def weigh(self, terms: DataFrame, id_col: str, n_docs: int) -> DataFrame:
        tf = 1 + F.log(F.col("tf").cast("double")) if self.sublinear_tf else F.col("tf").cast("double")
        idf = F.lit(1.0) if not self.use_idf else F.log((n_docs + 1.0) / (F.col("df") + 1)) + 1 if self.smooth_idf else F.log(n_docs / F.col("df")) + 1
        out = terms.withColumn("weight", tf * idf)
        if self.norm:
            size = F.sqrt(F.sum(F.col("weight") ** 2)) if self.norm == "l2" else F.sum(F.abs("weight"))
            norms = out.groupBy(id_col).agg(size.alias("_norm"))
            out = out.join(norms, id_col).withColumn("weight", F.when(F.col("_norm") > 0, F.col("weight") / F.col("_norm")).otherwise(0.0)).drop("_norm")
        return out.select(id_col, "token", "weight")


class TfidfVectorizer(CountVectorizer):
    defaults = CountVectorizer.defaults | TfidfTransformer.defaults

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        kw = {k: getattr(self, k) for k in TfidfTransformer.defaults}
        return TfidfTransformer(**kw).weigh(self.terms(df, id_col), id_col, self.n_docs)


class HashingVectorizer(CountVectorizer):
    """Token counts by hash bucket, the same in every process."""

    defaults = CountVectorizer.defaults | {"n_features": 1 << 20, "norm": "l2"}

    def fit(self, df, column):
        self.column = column
        return self

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.n_features))
        rows = df.select(id_col, F.explode(self._tokens(self.column)).alias("token")).groupBy(id_col, bucket.alias("bucket")).agg((F.lit(1.0) if self.binary else F.count(F.lit(1)).cast("double")).alias("weight") if not self.binary else F.max(F.lit(1.0)).alias("weight"))
        if not self.norm:
            return rows
        norms = rows.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_n") if self.norm == "l2" else F.sum("weight").alias("_n"))
        return rows.join(norms, id_col).select(id_col, "bucket", (F.col("weight") / F.col("_n")).alias("weight"))
