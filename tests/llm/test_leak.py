import itertools
import random

import numpy as np

from chalkline.llm import leak
from chalkline.llm.leak import MATCH, Items, WuManber, find_leaks, leaked_items, squash

SYLLABLES = "ka lo mi re tu sa ven dor pil gar nes bo ti ru".split()


def sentence(rnd, n):
    return [("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))) for _ in range(n)]


def test_search_finds_every_occurrence():
    rnd = random.Random(1)
    codes = np.array([rnd.randint(1, 3) for _ in range(20_000)], np.uint8)
    starts = np.array(sorted(rnd.sample(range(0, 20_000 - MATCH), 60)))
    texts = np.array([rnd.randint(1, 3) for _ in range(30_000)], np.uint8)
    for s in starts[:30]:
        at = rnd.randrange(0, 30_000 - MATCH)
        texts[at : at + MATCH] = codes[s : s + MATCH]
    found = WuManber(codes, starts)
    place, string = found.find(texts, lane=257)
    strings = {codes[s : s + MATCH].tobytes() for s in starts}
    data = texts.tobytes()
    want = [i for i in range(len(data) - MATCH + 1) if data[i : i + MATCH] in strings]
    assert place.tolist() == want
    for i, k in zip(place, string):
        o = found.occurrences[found.offsets[k]]
        assert data[i : i + MATCH] == codes[o : o + MATCH].tobytes()


def test_squash_drops_what_does_not_matter():
    a, _ = squash(["Größe, É\n- x-\ny"])
    b, _ = squash(["große e xy"])
    assert a.tolist() == [x for x in b.tolist()] or len(a) == len(b) - 1


def test_planted_passages(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(sentence(rnd, 60))) for i in range(40)]
    docs, want = [], set()
    for d in range(200):
        words = sentence(rnd, 150)
        kind = d % 5
        item, text = items[d % 40]
        own = text.split()
        if kind == 1:  # whole, other case and spacing, with a page line inside
            part = [w.upper() for w in own]
            words[70:70] = part[:30] + ["\n— 7 —\n"] + part[30:]
            want.add((d, item))
        elif kind == 2:  # 30 words, one in ten replaced, misspelled or lost
            part = own[10:40]
            for k in range(5, 30, 10):
                part[k] = rnd.choice(["", "xxyyx", part[k][:-1] + "q"])
            words[40:40] = [w for w in part if w]
            want.add((d, item))
        elif kind == 3:  # too short
            words[40:40] = own[5:20]
        elif kind == 4:  # every third word another
            words[40:40] = [w if k % 3 else "zonk" for k, w in enumerate(own)]
        docs.append((d, " ".join(words), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "—", 1)]
    items += [(100, items[1][1]), (101, None), (102, ""), (103, "too short to be found")]
    want |= {(d, 100) for d, i in want if i == 1}
    a = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(a, b).collect()}
    assert got == want
    several = {(r.doc_id, r.item_id) for r in leaked_items(a, b, max_item_bytes=4000).collect()}
    assert several == want
    assert leaked_items(a, b.limit(0)).count() == 0
    assert leaked_items(a.limit(0), b).count() == 0


def test_a_long_text_and_hyphens():
    rnd = random.Random(9)
    item = sentence(rnd, 40)
    broken = " ".join(item[:12]) + " " + item[12][:2] + "-\n" + item[12][2:] + " " + ", ".join(item[13:])
    text = " ".join(sentence(rnd, 200_000)) + " " + broken
    found = find_leaks(Items([7], [" ".join(item)]), ["nothing here", text, None])
    assert [(d, i) for d, i, _ in found] == [(1, 7)] and found[0][2] >= 38


def test_a_passage_of_many_items_is_found_for_each():
    rnd = random.Random(11)
    shared = sentence(rnd, 40)
    versions = [" ".join(sentence(rnd, 30) + shared + sentence(rnd, 30)) for _ in range(12)]
    own = " ".join(sentence(rnd, 60))
    broken = [w if k % 9 != 4 else "zonk" for k, w in enumerate(shared)]
    texts = [" ".join(sentence(rnd, 50) + part + sentence(rnd, 50)) for part in (shared, broken, shared[:20], [])]
    found = find_leaks(Items(range(13), [*versions, own]), texts)
    assert {(d, i) for d, i, _ in found} == {(d, i) for d in (0, 1) for i in range(12)}


def test_fewest_finds_of_a_passage():
    rnd = random.Random(12)
    words = [rnd.choice(["a", "ab", "abcdefghijklm", "abcd", "abcdef"]) for _ in range(15)]
    items = Items([1, 2], [" ".join(words), "ba " * 14])
    (n, exact, around), *longer = items.least(9, 4)
    assert n == 9 and [x[0] for x in longer] == [12, 16]
    begins = items.words.tolist() + [len(items.codes)]
    for a in range(7):
        kept = []
        for wrong in itertools.combinations(range(a, a + 9), 2):
            strings = [s for s in range(a, a + 9) if begins[s] + MATCH <= begins[a + 9]]
            kept.append(sum(all(not s <= w or begins[s] + MATCH <= begins[w] for w in wrong) for s in strings))
        assert exact[a] == max(min(kept), 1)
        assert around[a] == min(exact[: a + 1])
    assert (exact[7:15] > 1000).all()


def test_longest_run_in_pieces_of_a_long_item(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(40):
        known, rare = rng.random(200) < 0.9, rng.random(200) < 0.2
        whole = leak._admissible(known, rare, 25, 8)
        best = 0
        for a in range(200):
            for b in range(a + 25, 201):
                if known[a] and known[b - 1] and (~known[a:b]).sum() * 8 <= b - a and 2 * (known & rare)[a:b].sum() >= rare[a:b].sum():
                    best = max(best, b - a)
        assert whole == best
        monkeypatch.setattr(leak, "PAIRS", 1000)
        assert leak._admissible(known, rare, 25, 8) == best
        monkeypatch.undo()
