"""Small document tables with the awkward cases that every operator must bear."""

import random

import public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
VOCAB = ["the", "of", "and", "rain", "house", "Green", "été", "größe", "niño", "walk", "stone,", "river.", "42", "cloud", "lamp"] + [f"w{i}" for i in range(300)]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(VOCAB) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(n))


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t", "one", "two words", "a b c d", " nbsp em 😀 emoji", "aaaa " * 4000, "x" * 50_000, "same line\nsame line\nother\n\nsame line"]
    texts += [prose(rng, rng.choice([4, 12, 60, 150, 400])) for _ in range(n)]
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + passage + prose(rng, 40) for _ in range(6)]
    base = prose(rng, 120).split()
    for k in (0, 1, 2, 3, 5, 9):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [texts[20], texts[20], texts[25]]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s2", "s2", None, "é9"][i % 6], len(t or ""), "x") for i, t in enumerate(texts)]
    return out + [out[30], out[30], (None, "no id here but words", None, None, 0, None), (None, None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
