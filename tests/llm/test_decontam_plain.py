"""Benchmark windows against a plain count, for texts without numbers, names or units."""

import random

from flipline.llm import decontam

DOCS = "doc_id long, text string, h long, pos string"


def plain(docs, items, window=decontam.WINDOW):
    found = {}
    for item_id, item in items:
        words = (item or "").lower().split()
        runs = [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []
        for doc_id, text in docs:
            own = (text or "").lower().split()
            size = min(window, len(words))
            held = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            if len(words) < window and len(own) != len(words) and len(words) < decontam.LEAST_INSIDE:
                held = set()
            shared = sum(r in held for r in runs)
            if shared and (shared >= decontam.LEAST_WINDOWS or shared / len(runs) >= decontam.LEAST_SHARE):
                found[doc_id, item_id] = (shared, len(runs))
    return found


def test_windows_against_plain(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("bcdfgm") + rng.choice("aeiou") + rng.choice("zvwx") + rng.choice("aeiou")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 40])))) for i in range(30)] + [(90, ""), (91, None)]
    docs = [(1, None), (2, "")]
    for i in range(150):
        words = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            part = part.split()
            if rng.random() < 0.4 and len(part) > 3:
                part = part[rng.randrange(3) :] if rng.random() < 0.5 else [*part[: len(part) // 2], word(), *part[len(part) // 2 + 1 :]]
            words += [p.upper() if rng.random() < 0.2 else p for p in part] + [word() for _ in range(rng.randrange(3))]
        docs.append((10 + i, " ".join(words)))
    docs += [(500 + i, t) for i, t in items[:12]] + [docs[5], docs[9]]
    out = decontam.contaminated(
        spark.createDataFrame([(d, t, 1, "p") for d, t in docs], DOCS), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, slots int")
    ).collect()
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_windows) for r in out}
    assert got == plain(docs, items) and len(got) > 60 and len(out) == len(got)
