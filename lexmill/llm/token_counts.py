"""Token counts by a map-side two-tier lookup.

A text splits into pre-tokens that no piece of the vocabulary crosses: a run of spaces with the non-space run after
it, line feeds apart. Counts of pre-tokens add up to the count of the text. The first tier is a broadcast table with
the lengths of the frequent pre-tokens, those that the vocabulary itself was built to hold (bounded by its size); the
second is a bounded cache in each worker, filled by encoding what the first tier misses. Pre-tokens are never
shuffled.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame

from lexmill.llm.common import append, kept_names, table
from lexmill.llm.pieces import read_model

SPACE = "▁"
PRETOKEN = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


def separable(pieces: list[str]) -> bool:
    """Whether no piece continues past the places where texts are split."""
    return not any(re.search("[^▁]▁", x) or "\n" in x for x in pieces)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def plain_spaces(path: str) -> None:
    """Raises unless the model's normaliser changes spaces alone, as piece_count does."""
    m = read_model(path)
    if m.map or m.squeeze or not m.dummy_prefix:
        raise ValueError(f"{path}: its normaliser changes more than spaces; encode with lexmill.llm.pieces instead")


class Counts(dict):
    """Pre-token lengths: a miss is encoded once and kept, until the cache is full and starts anew."""

    def __init__(self, frequent: dict[str, int], model, limit: int) -> None:
        super().__init__(frequent)
        self.frequent, self.model, self.limit = frequent, model, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        # The model puts a space mark before what it is given; a token that starts with one must not get two.
        n = len(self.model.encode(token[1:])) if token[0] == SPACE and len(token) > 1 else len(self.model.encode("\n" + token)) - 2
        self[token] = n
        return n


def piece_count(text: str, lengths: Counts) -> int:
    if not text:
        return 0
    return sum(map(lengths.__getitem__, PRETOKEN.findall(SPACE + text.replace(" ", SPACE))))


_CACHE: dict[str, Counts] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096, cache: int = 300_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, as the library counts whole texts. Null counts as empty:
    no bytes, no tokens. Repeated rows stay. Other columns are not read."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    plain_spaces(path)
    model = load(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if not separable(pieces):
        raise ValueError(f"{path}: pieces cross pre-tokens")
    own = Counts({}, model, 1 << 30)
    frequent = docs.sparkSession.sparkContext.broadcast({x: own[x] for x in pieces if re.fullmatch("▁[^▁]+", x)})

    def make():
        if path not in _CACHE:
            _CACHE[path] = Counts(frequent.value, load(path), cache)
        lengths = _CACHE[path]

        def run(texts):
            rows = []
            for t in texts:
                n = piece_count((t or b"").decode(), lengths)
                rows.append((len(t or b""), n, n > limit))
            return rows

        return run

    counted = append(docs, text_col, make, "n_bytes long, n_tokens long, over_limit boolean", [id_col, *keep])
    added = ["n_bytes", "n_tokens", "over_limit"]
    return counted.toDF("doc_id", *kept_names(keep, ["doc_id", *added]), *added)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
