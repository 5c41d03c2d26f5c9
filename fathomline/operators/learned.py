"""A pair scorer learned from judged pairs of query and content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.binding import let
from fathomline.functions.trigram import held_trigrams, padded_words, trigrams
from fathomline.operators.rerank import ASKED, HELD
from fathomline.session import cut_lineage

FEATURES = ("asked_found", "content_asked", "words_found", "leading_words", "pairs_found", "length")


def pair_features(query: Column, content: Column) -> Column:
    """The features of a pair as an array, all between 0 and 1; NULL counts as empty.

    Shares of the query's trigrams in the content, of the content's in the
    query, of the query's words in the content, of its words before the first
    that is missing, of its neighbouring words that are neighbours there, and a
    damped length of the content.
    """
    return let(query_parts(query), lambda q: let(content_parts(content), lambda c: features_of(q, c)))


def query_parts(query: Column) -> Column:
    """What the features need of a query: its trigrams, and its words and neighbouring words as they stand in padded words."""
    text = F.coalesce(query, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def parts(w: Column) -> Column:
        after = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.struct(
            trigrams(text).alias("grams"),
            F.transform(w, lambda x: F.concat(F.lit(" "), x, F.lit(" "))).alias("words"),
            F.transform(after, lambda x, i: F.concat(F.lit(" "), F.get(w, i), F.lit("   "), x, F.lit(" "))).alias("pairs"),
        )

    return let(words, parts)


def content_parts(content: Column) -> Column:
    """What the features need of a content: its padded words, the number of its trigrams, its length."""
    text = F.coalesce(content, F.lit(""))
    return F.struct(
        padded_words(text).alias("padded"), F.size(trigrams(text)).alias("n_grams"), F.length(text).alias("length")
    )


def features_of(q: Column, c: Column) -> Column:
    """``pair_features`` of the parts of a query and of a content."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)

    def stands(text: Column) -> Column:
        return F.contains(c["padded"], text)

    words, pairs = q["words"], q["pairs"]
    of_grams = let(
        F.size(held_trigrams(q["grams"], c["padded"])), lambda n: F.array(share(n, F.size(q["grams"])), share(n, c["n_grams"]))
    )
    missing = F.array_position(F.transform(words, stands), False)
    before = let(missing, lambda at: F.when(at == 0, F.size(words)).otherwise(at - 1))
    of_words = F.array(
        share(F.size(F.filter(words, stands)), F.size(words)), share(before, F.size(words)),
        share(F.size(F.filter(pairs, stands)), F.size(pairs)),
    )
    return F.concat(of_grams, of_words, F.array(1 / (1 + F.log1p(c["length"].cast("double")))))


class PairParts:
    """The parts of a pair that do not depend on what a model learns; they can be computed before query and content meet."""

    def asked(self, query: Column) -> Column:
        return query_parts(query)

    def held(self, content: Column) -> Column:
        return content_parts(content)

    def score(self, asked: Column, held: Column) -> Column:
        raise NotImplementedError("parts alone have no score")


PAIR_PARTS = PairParts()


@dataclass(frozen=True)
class PairModel(PairParts):
    """A logistic model over ``pair_features``; called with two columns it is a scorer for ``rerank``, all in the JVM."""

    weights: tuple[float, ...]
    intercept: float

    def __call__(self, query: Column, content: Column) -> Column:
        return self._chance(pair_features(query, content))

    def score(self, asked: Column, held: Column) -> Column:
        return self._chance(features_of(asked, held))

    def _chance(self, features: Column) -> Column:
        weights = F.array(*map(F.lit, self.weights))
        terms = F.zip_with(features, weights, lambda x, w: x * w)
        return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(self.intercept), lambda total, x: total + x)))


def fit_pair_model(
    pairs: DataFrame, query_col: str = "search_text", content_col: str = "content", label_col: str = "label", max_pairs: int | None = None
) -> PairModel:
    """A model of all judged ``pairs``; those with a NULL label say nothing.

    The features of each pair are computed once and written; the passes of the
    fit add up sums inside tasks. What ``with_asked`` and ``with_held``
    computed of ``PAIR_PARTS`` beforehand is used. With one kind of label only,
    the model gives its share to every pair. Only a caller that sets
    ``max_pairs`` has about that many learned from, chosen by a hash of the
    pair, so that the same pairs are chosen however they are spread.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if ASKED in pairs.columns and HELD in pairs.columns:
        features = let(F.col(ASKED), lambda a: let(F.col(HELD), lambda h: features_of(a, h)))
    else:
        features = pair_features(F.col(query_col), F.col(content_col))
    judged = cut_lineage(
        pairs.where(F.col(label_col).isNotNull()).select(
            features.alias("features"), F.col(label_col).cast("double").alias("label"), F.xxhash64(query_col, content_col).alias("at")
        )
    )
    total, right = judged.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if right in (0, total):
        return PairModel((0.0,) * len(FEATURES), 0.0 if not total else (20.0 if right else -20.0))
    if max_pairs is not None and max_pairs < total:
        judged = judged.where(F.pmod("at", F.lit(1 << 20)) < int(max_pairs / total * (1 << 20)))
    fitted = LogisticRegression(regParam=1e-4, maxIter=50).fit(judged.select(array_to_vector("features").alias("features"), "label"))
    return PairModel(tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))
