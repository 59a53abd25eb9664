"""Small corpora for the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, n_words string, `count` int"


def corpus(seed=1, docs=60):
    """Texts with shared passages, copies, near copies, junk, null and empty ones, many alphabets."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñß日本") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, line, base = words(60), " ".join(words(12)), words(200)
    texts = ["", None, "   \n\t ", "one", "a b c", "no " * 120, "x" * 500, "é" * 300, "!!! ??? ###", "A\x00B \x1c c"]
    for k in range(docs):
        body = words(rnd.choice([3, 15, 25, 80, 300]))
        if k % 3 == 0:
            at = rnd.randint(0, len(body))
            body[at:at] = passage[rnd.randint(0, 20) : rnd.randint(35, 60)]
        if k % 4 == 0:
            body = list(base)
            for _ in range(k % 5):
                body[rnd.randrange(len(body))] = rnd.choice(vocabulary)
        text = " ".join(body)
        if k % 5 == 0:
            text += f"\n{line}\n" + " ".join(words(30)) + f"\n{line}"
        texts.append(text)
    texts += [texts[15], texts[20], texts[-1]]
    ids = list(range(0, 3 * len(texts), 3))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    """Rows as documents, with columns that no operator knows or that are named as theirs are."""
    full = [(d, t, ("en", None, "de")[(d or 0) % 3], f"s{(d or 0) % 2}", None if t is None else len(t), 5, "x", 1) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)
