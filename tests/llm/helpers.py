"""Small tables with every odd case, and plain versions of what operators compute."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slice string, row int, key string, kept string, node string, shard string, hash string"
WORDS = "the of and to river stone café über mountain 12 quiet señor lamp, lamp. Glass glass window door".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))


def odd_texts(seed=0):
    rng = random.Random(seed)
    base = prose(rng, 120)
    long = prose(rng, 6000)
    return [
        None, "", " ", "\n\t", "one", "one two", "one  two", "one two", base, base, base.replace(" ", "  ", 5), base + " end",
        base.replace("river", "brook", 1), "   lead and trail  ", "a b c", "x" * 3000, "ab" * 2000 + " " + "ab" * 2000, long, long + " tail", "tail " + long,
        "<|endoftext|> and <|startoftext|>", "▁mark ▁", "emoji \U0001F600\U0001F600 done", "line\nline\nLine", "é é İ", "0" * 49, "0" * 50, "0" * 51,
        *[prose(rng, rng.randrange(1, 90)) for _ in range(20)],
    ]


def table(spark, texts, first_id=0, source=None):
    rows = [(first_id + i, t, "en" if i % 3 else None, (source or (lambda j: f"s{j % 4}" if j % 5 else None))(i), None if t is None else len(t), "x", 1, "k", "y", "n", "s", "h")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n, lower=False):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if lower:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
