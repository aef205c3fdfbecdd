"""Test data and plain counterparts of the corpus operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, rank string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "stone river light garden winter copper silent meadow thunder paper harbor velvet orchard lantern cedar marble".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(30)) for _ in range(n))


def corpus():
    """Nulls, blanks, copies, near copies, repeated rows, one long text, symbols, clashing extra columns."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(3, 120)) for _ in range(30)]
    base = prose(rng, 90).split()
    for k in range(14):  # near copies at many distances
        w = list(base)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [texts[1].upper(), "", " \n\t ", None, None, "one", "one", "a b c d", "A b\nc  d", "x " * 300]
    texts.append("\n".join(prose(rng, 12) for _ in range(400)))
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s0", "s1"][i % 4], None if t is None else len(t), 7, "r") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here", "en", "s0", 10, 7, "r")]


def repeat_words(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def greedy(text, ref):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in ref:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def brute_components(rows, percent):
    sets, first = {}, {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    ids = sorted(sets)
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and label[b] < label[a] and 100 * len(x & y) >= percent * len(x | y):
                    label[a], moved = label[b], True
    return sets, label


def brute_kept(texts, least):
    """Texts without the lines of runs of ``least`` words that occur at an earlier position, all pairs compared."""
    fold = re.compile(r"(?<=\n)|(?<=[.!?] )")
    cut = [fold.split(t) for t in texts]
    lines = [[" ".join(WORD.findall(s)) for s in c] for c in cut]
    out = []
    for d, x in enumerate(lines):
        gone = set()
        for c in range(d + 1):
            y = lines[c]
            for shift in range(1 if c == d else 1 - len(y), len(x)):
                run = []
                for p in range(max(0, shift), min(len(x), len(y) + shift) + 1):
                    if p < min(len(x), len(y) + shift) and x[p] == y[p - shift]:
                        run.append(p)
                        continue
                    if sum(len(x[k].split()) for k in run) >= least:
                        gone.update(run)
                    run = []
        out.append("".join(s for k, s in enumerate(cut[d]) if k not in gone))
    return out


SPANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sure(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(d[::-1])) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True
