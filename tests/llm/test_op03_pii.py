import hashlib
import random
import re
import time

import numpy as np

from wayline.llm import op03_pii as pii


def plain(text):
    """The contract's patterns as they are written."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(4)
    for alphabet in ("a.@-é1", "0123.", "12 -3", "+1()2 .-9", "a@b.c d1.2.3.4+5"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == plain(text), text
    for text in ("4111 1111 1111 1111", "4111111111111111x", "+44 (20) 7946-0958", "a@b.co.@c.d", "1.2.3.4.5.6.7.8", "0001.02.3.255", "１.２.３.４ ٤@b.c", "1.2.3.256.1.1.1.1"):
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for unit in ("1", "a", "a@", "1.", "+1(", "1 "):
        pii.base_spans(unit * 100_000)
    assert time.time() - began < 20


def test_kept_weights_are_those_of_training():
    assert np.allclose(pii.known_weights(), pii.trained(), atol=1e-3)


def test_field_finds_held_out_entities():
    """Forms that no base pattern finds: precision and recall of spans of their kind, and how many have the very bounds."""
    weights, r = pii.known_weights(), random.Random(99)
    added = right = exact = asked = found = 0
    for _ in range(600):
        text, spans = pii._sentence(r)
        base, got = pii.find(text, weights)
        new = set(got) - set(base)
        meets = lambda x, of: any(x[0] == k and x[1] < b and a < x[2] for k, a, b in of)
        hidden = [x for x in spans if x not in base]
        added, right, exact = added + len(new), right + sum(meets(x, spans) for x in new), exact + len(new & set(spans))
        asked, found = asked + len(hidden), found + sum(meets(x, got) for x in hidden)
    assert right / added > 0.98 and exact / added > 0.94 and found / asked > 0.8
    for text, kind, value in (("Call (132) 555-1352 today", 3, "(132) 555-1352"), ("write to anna (at) web (dot) org now", 0, "anna (at) web (dot) org"), ("john at mail dot com", 0, "john at mail dot com"), ("the dot at the top of 12 hills", None, None)):
        spans = [(k, text[a:b]) for k, a, b in pii.find(text, weights)[1]]
        assert value is None or (kind, value) in spans
        assert kind is not None or not spans


def test_field_on_very_long_texts():
    weights, began = pii.known_weights(), time.time()
    text = "12 " * 3_000 + "plain words of a text " * 20_000 + "call (132) 555-1352 " * 20
    assert sum(k == 3 for k, _, _ in pii.find(text, weights)[1]) == 20
    assert time.time() - began < 60


def test_dynamic_program_is_exact():
    """The best labelling and the partition sum against an enumeration of all labellings."""
    weights = np.random.default_rng(1).normal(size=(4, pii.N_FEATURES)) * 0.5
    lattice = pii.Lattice("a (132) 555-1352 b 12345678")
    score = lattice.scores(weights)

    def every(at):
        yield 0.0, []
        for k, (i, j) in enumerate(lattice.segments):
            if i >= at:
                for kind in range(4):
                    for s, rest in every(j):
                        yield s + score[k, kind], [(k, kind), *rest]

    found = list(every(0))
    best = max(found, key=lambda x: x[0])
    assert [(k, kind) for k, _, kind in lattice.best(score)] == best[1]
    post, log_z = lattice.marginals(score)
    assert np.isclose(log_z, np.logaddexp.reduce([s for s, _ in found]))
    assert np.isclose(post[best[1][0]], sum(np.exp(s - log_z) for s, labels in found if best[1][0] in labels))


def test_tables(docs_of):
    text = "é😀 mail a.b@c.de, 10.0.0.1 and +1 (132) 555-1352."
    df = docs_of([text, None, "", text], ids=[1, 2, 3, 1]).selectExpr("*", "'x' as spans", "1 as n_email")
    rows = pii.personal_data(df).orderBy("doc_id").collect()
    assert len(rows) == 4 and rows[0] == rows[1]
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 0, 1)
    assert rows[0].spans.startswith("email:8:16,ip:18:26,phone:31:48")
    assert rows[0].base_sha256 == hashlib.sha256(b"email:8:16,ip:18:26,phone:31:48").hexdigest()
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    kept = pii.mask_personal_data(df).orderBy("doc_id").collect()
    assert kept[0].text == "é😀 mail [email], [ip] and [phone]." and kept[0].n_chars == len(kept[0].text) and kept[2].text is None and kept[0].spans == "x"
    assert pii.personal_data(df.where("false")).count() == 0
