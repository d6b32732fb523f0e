"""Main text of web pages: a linear-chain CRF over leaf blocks, trained on labelled pages, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.crf import Crf, train
from reposift.llm.labelledpages import label_at, labelled_page
from reposift.llm.pageblocks import Block, leaf_blocks, path_features, text_features

#: Labelled pages that the field is trained on.
PAGES = 800
#: Scores of paths of elements that a task remembers.
PATHS = 50_000


def features(blocks: list[Block]) -> list[list[str]]:
    many = len(blocks)
    return [[*path_features(b.path), *text_features(b, i, many)] for i, b in enumerate(blocks)]


@lru_cache(maxsize=2)
def trained(pages: int = PAGES) -> Crf:
    """The field after ``pages`` labelled pages (seeds 0, 1, ...): the same in every run."""
    told = []
    for seed in range(pages):
        html, begins, labels = labelled_page(seed)
        blocks = leaf_blocks(html)
        told.append((features(blocks), [label_at(begins, labels, b.begin) for b in blocks]))
    return train(told)


class Reader:
    """The main text of pages by a trained field; what a path of elements scores is worked out once."""

    def __init__(self, field: Crf):
        self.field, self.paths = field, {}

    def blocks(self, html: str | None) -> tuple[list[Block], list[int]]:
        """Leaf blocks and the state of each: 1 in the article."""
        found, weights = leaf_blocks(html), self.field.weights
        scores = []
        for i, block in enumerate(found):
            path = self.paths.get(block.path)
            if path is None:
                if len(self.paths) >= PATHS:
                    self.paths.clear()
                path = self.paths[block.path] = sum(weights.get(f, 0.0) for f in path_features(block.path))
            scores.append(path + sum(weights.get(f, 0.0) for f in text_features(block, i, len(found))))
        return found, self.field.viterbi(scores)

    def text(self, html: str | None) -> str:
        found, states = self.blocks(html)
        return "\n".join(b.text for b, state in zip(found, states) if state)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), pages_trained: int = PAGES) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of the article of each page, read from the whole ``html``.

    Blocks of the article are joined by one line feed in page order.  A null or
    empty page, and one without an article, has the empty text.  Repeated rows
    give repeated rows; an empty table gives none; columns that aren't kept are
    ignored.  No row leaves its task.
    """
    field = trained(pages_trained)
    kept = [pages.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(field)
        for batch in batches:
            texts = [reader.text(html.as_py()) for html in batch.column("_html")]
            columns = [batch.column(i) for i in range(len(kept))]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select(*[F.col(f.name) for f in kept], F.col("html").cast("string").alias("_html")).mapInArrow(
        run, f"{schema}, text string, n_chars long")
