"""Text as Column expressions: tokens, stems, grams, normal forms, similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the search index leaves out.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could of in to for "
    "with on at by from as into through during and or but not no if then than that this it its he she his her we they them our "
    "said also one two who what when where how all each every both few more most other some such only own same so very just about "
    "https http www com org html htm"
).split()
#: Places where a word ends inside camel case; no two overlap, and groups are found faster than by look-around.
CAMELS = ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])")
BREAKS = r"""[\s\-_/.,;:!?()\[\]{}"|]+"""


def stem(word: Column) -> Column:
    """Takes off -ies, -ing, -ed and -s where enough of the word is left."""
    n = F.length(word)
    cut = lambda k: F.substring(word, 1, n - k)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ing") & (n > 5), cut(3))
        .when(word.endswith("ed") & (n > 4), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Stems of a text in order; null and empty texts have none."""
    apart = F.coalesce(text, F.lit(""))
    for camel in CAMELS:
        apart = F.regexp_replace(apart, camel, "$1 $2")
    parts = F.split(F.lower(apart), BREAKS)
    good = lambda t: F.length(t).between(2, 100) & ~t.isin(STOP_WORDS)
    return F.filter(F.transform(F.filter(parts, good), stem), good)


def pairs_of(words: Column) -> Column:
    """Neighbouring words joined by two underscores."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit("__"), b))


def trigrams(word: Column) -> Column:
    """Character trigrams; a shorter word is its own."""
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3))))


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))


def capital(letter: Column) -> Column:
    """A letter in upper case, one letter again: ß becomes ẞ, and a letter whose upper case are several stays, as in the SQL."""
    return F.when(letter == "ß", "ẞ").when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(letter)


def key_of(text: Column) -> Column:
    return F.lower(F.trim(text))


def slug(text: Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
