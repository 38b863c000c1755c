import random


def corpus():
    """Documents of two languages with an equal copy (301), a near copy (302) and a benchmark passage (303)."""
    r = random.Random(7)
    parts = {"aa": ["the", "of", "and", "thing", "with", "house", "river"], "bb": ["der", "und", "schön", "nicht", "für", "haus", "fluss"]}

    def text(lang, n):
        return " ".join(f"{r.choice(parts[lang])}{r.choice('xyz')}" for _ in range(n))

    docs = [(i, text(g, 60), g, f"s{i % 3}") for i, g in enumerate(["aa", "bb"] * 30)]
    base = docs[10][1]
    passage = text("aa", 20)
    docs += [(301, base.replace(" ", "  "), "aa", "s1"), (302, docs[12][1] + " tail", "aa", "s1"), (303, text("aa", 30) + " " + passage, "aa", None), (304, None, None, None), (305, "12 34", "bb", "s0")]
    return [(*d, len(d[1] or "")) for d in docs], [(1, passage), (2, "")]
