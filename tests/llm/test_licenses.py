import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import licenses
from lexispark.llm._text import utf8


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    out = ["", None, "the", "!?", say(3)]
    for _ in range(4):
        for _, t in licenses.catalogue():
            w = t.split()
            if len(w) > 2000 and rng.random() < 0.7:
                continue
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = "changed"
            out.append(f"{say(rng.randrange(0, 90))}\n{' '.join(w).upper()} {say(rng.randrange(0, 40))}")
    out += [say(300) for _ in range(20)] + [t for _, t in licenses.NOTICES] + [licenses.NOTICES[0][1] * 300 + say(20_000)]
    return out


def brute(text, templates, containment=0.8):
    """In plain Python: every window of every template by sets of shingles."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", low(text))]
    said = [w for *_, w in spans]
    shingles = [tuple(said[i : i + 5]) for i in range(len(said) - 4)]
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text or ""])])
    found = []
    for name, t in templates:
        own = re.findall(r"[a-z0-9\x80-\U0010ffff]+", low(t))
        grams = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        a, kinds = len(grams), set(grams)
        must = {g for g in grams if any(w.isdigit() for w in g)} if len(own) < 40 else set()
        stride = 1 if a < 8 else 2 ** int(math.log2(a / 4))
        width = a if a < 8 else 9 * stride
        need = math.ceil(containment * len(kinds) - 1e-9)
        begin = 0
        while shingles:
            here = [i for i in range(begin, min(begin + width, len(shingles))) if shingles[i] in kinds]
            shared = {shingles[i] for i in here}
            if len(shared) >= need and must <= shared:
                found.append((name, int(at[spans[here[0]][0]]), int(at[spans[here[-1] + 4][1]]), len(shared) / len(kinds)))
            if begin + width >= len(shingles):
                break
            begin += stride
    out = []
    for m in sorted(found):
        if out and out[-1][0] == m[0] and m[1] < out[-1][2]:
            out[-1] = (m[0], out[-1][1], max(out[-1][2], m[2]), max(out[-1][3], m[3]))
        else:
            out.append(m)
    return out


def test_against_brute_force(texts):
    templates = licenses.catalogue()
    ready = licenses.prepare(templates, 0.8, 0.9999)
    got = licenses.matches(*utf8(pa.array(texts, pa.string())), ready, 0.8)
    assert got == [brute(t, templates) for t in texts]
    assert sum(map(len, got)) > 100


def test_bands_lose_nothing(texts):
    """Against exact containment in every window, without any bands."""
    ready = licenses.prepare(licenses.catalogue(), 0.8, 0.9999)
    data = utf8(pa.array(texts, pa.string()))
    assert licenses.matches(*data, ready, 0.8) == licenses.matches(*data, ready, 0.8, retrieve=False)


def test_copies_are_found():
    ready = licenses.prepare(licenses.catalogue(), 0.8, 0.9999)
    rng = random.Random(9)
    for name, t in licenses.NOTICES:
        for _ in range(5):
            before = "é x " * rng.randrange(0, 50)
            text = before + t + " y" * rng.randrange(0, 50)
            found = licenses.matches(*utf8(pa.array([text])), ready, 0.8)[0]
            whole = [m for m in found if m[0] == name and m[3] == 1]
            assert whole and whole[0][1] == len(before.encode()) and text.encode()[whole[0][1] : whole[0][2]].decode() == t.rstrip(".")


def test_versions_and_texts():
    ready = licenses.prepare(licenses.catalogue(), 0.8, 0.9999)
    names = lambda t: {m[0] for m in licenses.matches(*utf8(pa.array([t])), ready, 0.8)[0]}
    line = "This work is licensed under the GNU General Public License, version {}."
    assert names(line.format(3)) == {"GPL-3.0-only"} and names(line.format(2)) == {"GPL-2.0-only"} and names(line.format(9)) == set()
    for name, text in licenses.catalogue()[len(licenses.NOTICES) :]:
        assert name in names("before it " + text + " after it")


def test_many_templates():
    """The cost of the search is that of the text, not that of the list."""
    import time

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    text = pa.array([" ".join(rng.choices(words, k=150_000))])
    took = []
    for n in (12, 600):
        ready = licenses.prepare([(str(i), " ".join(rng.choices(words, k=20 + i % 80))) for i in range(n)], 0.8, 0.9999)
        licenses.matches(*utf8(text), ready, 0.8)
        began = time.process_time()
        licenses.matches(*utf8(text), ready, 0.8)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.2
    assert len(licenses.seeds(500)) == 500 and licenses.prepare([("x", "a b c d e f g h i j k l m")], 0.2, 1 - 1e-14).levels[0].bands > 256


def test_guarantee():
    rng = np.random.default_rng(0)
    for a, m in ((1, 1), (5, 5), (40, 72)):
        bands = licenses.bands_for(a, m, 0.8, 0.99)
        share = int(np.ceil(0.8 * a))
        met = 0
        for _ in range(400):
            t = rng.integers(0, 1 << 63, a).astype(np.uint64)
            w = np.concatenate([t[:share], rng.integers(0, 1 << 63, m - share).astype(np.uint64)])
            met += any(licenses._least(t, s).min() == licenses._least(w, s).min() for s in licenses.seeds(bands))
        assert met >= 0.97 * 400


def test_frames(spark, texts):
    df = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, LICENSES int")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "licenses"] and got.count() == len(texts)
    assert all(not r.licenses for r in got.collect() if not r.text)
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("X", "too short")])
