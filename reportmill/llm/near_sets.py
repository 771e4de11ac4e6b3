"""Near copies by the similarity of their shingles: what the pipeline's near-duplicate stage looks for after SimHash.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them and no others. The 64-bit
fingerprints of :mod:`simhash` cannot tell that: two texts at 0.8 differ in about ten bits, as do many at 0.7.

The search is that of :mod:`jaccard_join`. There a large group of sets that meet by chance is parted by sketches, so that whole sets are moved only
where sketches fit, and a large group of near copies by what is linked already.

Defined results: null text is empty; texts without words have the empty set, which links like any other; null ids take part, and
a component's id is its smallest id that is not null (null if there is none); repeated rows get one result each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from reportmill.llm.common import one_of_each
from reportmill.llm.jaccard_join import jaccard_classes

#: Words of a shingle, least Jaccard similarity; sets of a part of a group, about.
WORDS, SIMILARITY, SET_PART = 5, 0.8, 4096


def near_dedup_similar(docs: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Links by similarity of five-word shingles. One row per document: id, component_id."""
    return jaccard_classes(docs, similarity, WORDS, text_col, id_col, SET_PART, empty=True).select(id_col, "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns, as :func:`common.one_of_each` takes it."""
    return one_of_each(docs, lambda keyed: near_dedup_similar(keyed, similarity, "text", "key"), text_col, id_col)
