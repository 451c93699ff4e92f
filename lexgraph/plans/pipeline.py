"""Laws to triples as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ro
from ..operators import cite, resolve, segment, store
from ..runtime import spread


def regex_triples(articles: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Citation triples of articles (law_id, article_number, text): the citing act, the relation, and the cited act's identifier or wording.

    Citations of the act itself are left out. Rows without a law_id cite nothing.
    """
    cited = cite.cited(articles.where(F.col("law_id").isNotNull()).select("law_id", "article_number", "text"), "text")
    cited = cited.where(~cite.is_self(F.col("law_id"), F.col("surface")))
    resolved = resolve.resolve(cited, "surface", aliases, "_tail")
    rows = resolved.select(F.col("law_id").alias("head"), "relation", F.coalesce("_tail", "surface").alias("tail"), "law_id", "article_number").distinct()
    return cite.tagged(rows)


def corpus_triples(laws: DataFrame, meta: DataFrame, llm: DataFrame | None = None, *, max_laws: int | None = None, max_articles: int | None = None) -> DataFrame:
    """(law_id, law_text) rows to deduplicated, canonical triples, with recorded model triples beside the citations.

    Order as in the original pipeline: union, self-references of the text, canonical entities, best
    confidence. Texts are spread over all cores first, since a file of laws has few splits.
    """
    aliases = resolve.alias_dim(meta)
    texts = spread(segment.first_laws(laws, max_laws).select("law_id", normalize_ro(F.col("law_text")).alias("law_text")))
    articles = segment.first_articles(segment.split_into_articles(texts), max_articles)
    triples = regex_triples(articles, aliases)
    if llm is not None:
        triples = store.merge(triples, llm)
    own = resolve.resolve_anaphora(store.conform(triples), F.col("law_id"))
    return store.best_confidence(resolve.canonicalize(own, ["head", "tail"], aliases))
