"""English word forms: Porter's second stemmer as a staged rewrite of a table of words.

The stages are plain projections over distinct words, so a corpus pays for its
vocabulary, not for its length. Words come lower-cased and without apostrophes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import literal_map
from keepsake.schema import STEM_ALONE, STEM_AS, STEM_KEPT, STEM_STEP_2, STEM_STEP_3, STEM_STEP_4

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
# a vowel between consonants at the end, the last of them none of w, x and Y; or a whole word of vowel and consonant
SHORT = rf"({OTHER}{VOWEL}[^aeiouywxY]$)|(^{VOWEL}{OTHER}$)"


def _without(w: Column, n: Column | int) -> Column:
    return F.substr(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def _suffix(w: Column, endings: list[str]) -> Column:
    """The longest of the endings the word has, or an empty string: the match that starts first is the longest."""
    return F.regexp_extract(w, f"({'|'.join(endings)})$", 1)


def _plural(w: Column) -> Column:
    return (
        F.when(F.endswith(w, F.lit("sses")), _without(w, 2))
        .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike(rf"{VOWEL}.+s$"), _without(w, 1))
        .otherwise(w)
    )


def _restored(base: Column) -> Column:
    """What is left after -ed or -ing, made a word again."""
    return (
        F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
        .when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(base, 1))
        .when(base.rlike(SHORT) & (F.col("r1") >= F.length(base)), F.concat(base, F.lit("e")))
        .otherwise(base)
    )


def _replaced(w: Column, suffix: Column, endings: dict[str, str], allowed: Column) -> Column:
    """The suffix exchanged where it lies in the first region and the rule's own condition holds."""
    starts = F.length(w) - F.length(suffix)
    new = F.concat(_without(w, F.length(suffix)), F.try_element_at(literal_map(endings), suffix))
    return F.when((suffix != "") & (starts >= F.col("r1")) & allowed, new).otherwise(w)


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """The words with their ``stem``. Words of one or two letters are their own stems."""
    w, suffix, base = F.col("__w"), F.col("__suffix"), F.col("__base")
    region = rf"^.*?{VOWEL}{OTHER}"
    df = words.withColumn("__w", F.regexp_replace(F.regexp_replace(F.col(column), "^y", "Y"), f"({VOWEL})y", "$1Y"))
    first = F.regexp_extract(w, rf"^(?:{'|'.join(STEM_ALONE)}|.*?{VOWEL}{OTHER})", 0)
    df = df.withColumn("r1", F.when(F.length(first) > 0, F.length(first)).otherwise(F.length(w)))
    second = F.length(F.regexp_extract(F.substr(w, F.col("r1") + 1), region, 0))
    df = df.withColumn("r2", F.when(second > 0, F.col("r1") + second).otherwise(F.length(w)))

    df = df.withColumn("__w", _plural(w))
    df = df.withColumn("__kept", w.isin(STEM_KEPT)).withColumn("__one", w)
    df = df.withColumn("__suffix", _suffix(w, ["eedly", "eed", "ingly", "edly", "ing", "ed"]))
    df = df.withColumn("__base", _without(w, F.length(suffix)))
    agreed = F.when(F.length(base) >= F.col("r1"), F.concat(base, F.lit("ee"))).otherwise(w)
    df = df.withColumn(
        "__w", F.when(suffix == "", w).when(F.startswith(suffix, F.lit("eed")), agreed).when(base.rlike(VOWEL), _restored(base)).otherwise(w)
    )
    df = df.withColumn("__w", F.when(w.rlike(rf"^.+{OTHER}[yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w))

    df = df.withColumn("__suffix", _suffix(w, list(STEM_STEP_2)))
    before = _without(w, F.length(suffix))
    fits = (
        F.when(suffix == "ogi", F.endswith(before, F.lit("l"))).when(suffix == "li", before.rlike("[cdeghkmnrt]$")).otherwise(True)
    )
    df = df.withColumn("__w", _replaced(w, suffix, STEM_STEP_2, fits))

    df = df.withColumn("__suffix", _suffix(w, list(STEM_STEP_3)))
    deep = F.length(w) - F.length(suffix) >= F.col("r2")
    df = df.withColumn("__w", _replaced(w, suffix, STEM_STEP_3, (suffix != "ative") | deep))

    df = df.withColumn("__suffix", _suffix(w, STEM_STEP_4))
    fits = F.when(suffix == "ion", before.rlike("[st]$")).otherwise(True)
    df = df.withColumn("__w", F.when((suffix != "") & deep & fits, before).otherwise(w))

    at = F.length(w) - 1
    drop_e = F.endswith(w, F.lit("e")) & ((at >= F.col("r2")) | ((at >= F.col("r1")) & ~_without(w, 1).rlike(SHORT)))
    drop_l = F.endswith(w, F.lit("ll")) & (at >= F.col("r2"))
    df = df.withColumn("__w", F.when(drop_e | drop_l, _without(w, 1)).otherwise(w))

    known = F.try_element_at(literal_map(STEM_AS), F.col(column))
    stem = F.when(F.length(column) <= 2, F.col(column)).otherwise(
        F.coalesce(known, F.translate(F.when(F.col("__kept"), F.col("__one")).otherwise(w), "Y", "y"))
    )
    return df.withColumn("stem", stem).select(*[words[c] for c in words.columns], "stem")
