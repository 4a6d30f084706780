"""Text and set functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, and the constants of the 32-bit FNV-1a hash.
WORD_BREAK = r"[^\p{L}\p{N}_+#.\-]+"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def words(text: Column) -> Column:
    """Lower-case runs of letters, numbers and _ + # . - ; no empty ones."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def name_segments(text: Column) -> Column:
    """Parts of an identifier: at _ - and space, then before capitals."""
    parts = F.flatten(F.transform(F.split(text, r"[_\-\s]+"), lambda w: F.split(w, "(?=[A-Z])")))
    return F.filter(F.transform(parts, F.lower), lambda w: w != "")


def index_segments(text: Column) -> Column:
    """Parts of a key for the inverted index: non-alphanumerics, CJK borders and camel case; at least two characters."""
    cjk = r"一-鿿"
    marked = F.regexp_replace(text, rf"(?<=[{cjk}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{cjk}])|(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(marked), rf"[^a-z0-9{cjk}]+"), lambda w: F.length(w) > 1))


def present(*values: Column) -> Column:
    """The distinct ones of several strings that aren't null, in their order.

    Without a lambda: Spark makes code of all but lambdas, and finds in code what stands in several columns.
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters of the text without white space, in lower case; empty if it is shorter."""
    chars = F.filter(F.split(F.regexp_replace(F.lower(text), r"\s+", ""), ""), lambda c: c != "")

    def grams(c: Column) -> Column:
        many = F.size(c) - n + 1
        out = F.slice(c, 1, many)
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(c, k, many), lambda x, y: F.concat(x, y))
        return F.when(many > 0, out).otherwise(F.array().cast("array<string>"))

    # The inner function binds the characters, which are then split once for each text.
    return F.element_at(F.transform(F.array(chars), grams), 1)


def bigrams(text: Column) -> Column:
    """The distinct character pairs of a text."""
    return F.array_distinct(char_ngrams(text, 2))


def characters(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def _ratio(both: Column, every: Column) -> Column:
    return F.when(every > 0, both / every).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if both are empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_or_equal(a: Column, b: Column) -> Column:
    """Shared part of two sets; 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if it is empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def idf(n: Column, df: Column, kind: str = "smooth") -> Column:
    """Inverse document frequency: smooth ln((n+1)/(df+1))+1, segment ln(n/(df+1)), plain ln(n/df)."""
    return {"smooth": F.log((n + 1) / (df + 1)) + 1, "segment": F.log(n / (df + 1)), "plain": F.log(n / df)}[kind]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of characters in the basic plane, as a long."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME, F.lit(1 << 32))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), step)


def in_rollout(dimension: str, ident: Column, share: float) -> Column:
    """Whether an id falls into the first `share` of the buckets of a dimension."""
    return fnv1a(F.concat(F.lit(f"{dimension}:"), ident)) / float(2**32 - 1) < share


def path_key(path: Column) -> Column:
    """Path in lower case with forward slashes and none at its end."""
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", ""))


def path_similarity(a: Column, b: Column) -> Column:
    """1 equal, .8 same folder, .6 same parent folder, .4 same top folder, else 0; .5 if either is unknown."""
    x, y = F.split(a, "/"), F.split(b, "/")
    folder = lambda p, k: F.array_join(F.slice(p, 1, F.greatest(F.size(p) - k, F.lit(0))), "/")
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.5)
        .when(a == b, 1.0)
        .when(folder(x, 1) == folder(y, 1), 0.8)
        .when((F.size(x) > 2) & (F.size(y) > 2) & (folder(x, 2) == folder(y, 2)), 0.6)
        .when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), 0.4)
        .otherwise(0.0)
    )


def fingerprint(kind: Column, description: Column) -> Column:
    """Identity of a pattern: its kind and its trimmed, lower-case description."""
    return F.concat(F.lit("pattern-fp-"), F.substring(F.sha2(F.concat(kind, F.lit(":"), F.lower(F.trim(description))), 256), 1, 8))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def context_window(text: Column, start: Column, length: Column, radius: int = 50) -> Column:
    """The text around a place (counted from 0), with ellipses where it is cut."""
    lo = F.greatest(start - radius, F.lit(0))
    hi = F.least(start + length + radius, F.length(text))
    return F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def is_chinese(text: Column) -> Column:
    """Whether CJK characters are at least .12 of what isn't white space."""
    dense = F.length(F.regexp_replace(text, r"\s", ""))
    return (dense > 0) & (F.length(F.regexp_replace(text, r"[^一-鿿]", "")) / dense >= 0.12)


def representative_phrase(text: Column, limit: int = 150) -> Column:
    """The first sentence if it fits, else the text cut at a word."""
    sentence = F.regexp_extract(text, r"^(.*?[.!?。！？])(\s|$)", 1)
    cut = F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*$", "")
    return F.when((sentence != "") & (F.length(sentence) <= limit), sentence).when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))
