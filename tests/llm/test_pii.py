"""Problem 9: the tagger's gradients, its held-out accuracy, and what the exact check does."""

import numpy as np
import pytest

from rulegrid.llm import pii, pii_train, tagger


def test_gradients_match_finite_differences():
    w = {k: v.astype("f8") for k, v in tagger.new_weights(5, 3, 4).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(2, 60, (7, 3)), rng.integers(0, 5, (7, 3))
    _, grads = tagger.gradients({k: v.astype("f4") for k, v in w.items()}, x, y)
    for key in w:
        at = tuple(rng.integers(0, n) for n in w[key].shape) if key != "E" else (int(x[0, 0]), 1)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[key][at] += 1e-2
        down[key][at] -= 1e-2
        slope = (tagger.gradients({k: v.astype("f4") for k, v in up.items()}, x, y)[0] - tagger.gradients({k: v.astype("f4") for k, v in down.items()}, x, y)[0]) / 2e-2
        assert abs(slope - grads[key][at]) < 2e-3, key


def test_reading_equals_the_trained_forward_pass():
    w = tagger.new_weights(5, 6, 8)
    x = np.random.default_rng(1).integers(0, 100, (20, 4))
    e = w["E"][x]
    f, _ = tagger._lstm(e, w["Wf"], w["cf"], True)
    b, _ = tagger._lstm(e[::-1], w["Wb"], w["cb"], True)
    assert np.allclose(tagger.scores(w, x), np.concatenate([f, b[::-1]], 2) @ w["O"] + w["o"], atol=1e-5)


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.load())


HELD_OUT = [
    ("The complaint of Zarbelle Quornfeld was reopened.", "person_name", "Zarbelle"), ("Present: Q. Marrowby\nThe desk shall file.", "person_name", "Q. Marrowby"), ("Minutes were drafted by ULMORE, Tarvin and read aloud.", "person_name", "ULMORE"),
    ("Mail sent from <tarvin.ulmore@fernhill.example> bounced twice.", "email", "tarvin"), ("E-mail: desk+tarvin (at) fernhill.example\nIn view of it", "email", "desk"), ("E-mail: tarvin_u [at] post [dot] fernhill [dot] test", "email", "tarvin_u"),
    ("Call 07700 900123 during office hours.", "phone", "07700"), ("Tel: +1 (202) 555-0111\nE-mail", "phone", "+1"), ("Ph/Fax - (020) 7946 0888;", "phone", "(020)"),
    ("The client quoted identity number 0442-5582-1999 on the form.", "id_number", "0442"), ("KYC record QWEXT 1234 Z did not match.", "id_number", "QWEXT"), ("Proof supplied: Q7654321, verified at the branch.", "id_number", "Q7654321"),
    ("Notices go to Flat 7B, Elm House, Cobbler Lane, Westmarch - 012345.", "address", "Flat"), ("A visit was made to 12/C Cobbler Street\nWestmarch\n012345.", "address", "12/C"),
]


@pytest.mark.parametrize("text, kind, begins", HELD_OUT)
def test_unseen_mentions(finder, text, kind, begins):
    assert (kind, text.index(begins)) in [(k, s) for k, s, _ in finder.find([text])[0]]


@pytest.mark.parametrize(
    "text",
    ["Docket 4417-2093 was closed in the register.", "See clause 7.7.900 read with table 202.555.01 of the format.", "The levy stays @ 12 per cent of the base amount.", "Handles such as @haldenboard are not official channels.",
     "The file hash 9f3c 77aa 0194 5521 matched on both sites.", "Orrenby & Menvarra Brokers has since been merged.", "Juniper Road and Priory Close fall under the same zone.", "Ledger code HSBQX0417 applies throughout.", "", "\r\n\r\n", "x" * 3000],
)
def test_decoys(finder, text):
    assert finder.find([text]) == [[]]


def test_mentions_across_window_borders(finder):
    for pad in range(430, 530, 7):
        text = "The trustee shall keep records. " * 20
        text = text[:pad] + ". Mail sent from <tarvin.ulmore@fernhill.example> bounced. The complaint of Leshna Garudani was reopened."
        assert {(k, text[s:e]) for k, s, e in finder.find([text])[0]} == {("email", "tarvin.ulmore@fernhill.example"), ("person_name", "Leshna Garudani")}


def test_every_character_is_read(finder, monkeypatch):
    seen = []
    monkeypatch.setattr(tagger, "scores", lambda w, x, f=tagger.scores: seen.append((x > 0).sum()) or f(w, x))
    text = "The trustee shall keep records of all pledges. " * 40
    finder.find([text])
    assert sum(seen) >= len(text) and len(finder.starts(100_000)) * pii.WINDOW >= 100_000


def test_unseen_forms_are_found_where_the_usual_shapes_fail(finder):
    """Mentions of made-up names, street words and groupings: the model finds most, the shapes by themselves few."""
    rng, made = np.random.default_rng(123), []
    for text, kind, begins in HELD_OUT * 6:
        at = text.index(begins)
        if kind in ("phone", "id_number", "address"):
            hit = pii.shaped(kind, text, at, at + 5)
            made.append((kind, *pii_train.renamed("The trustee shall keep records. " + text, [(kind, hit[0] + 32, hit[1] + 32)], rng)))
    found = finder.find([t for _, t, _ in made])
    by_model = sum(any(k == kind and a < span[0][2] and b > span[0][1] for k, a, b in f) for (kind, _, span), f in zip(made, found))
    by_shape = sum(pii.shaped(kind, t, *span[0][1:]) == span[0][1:] for kind, t, span in made)
    assert by_model >= 0.9 * len(made) and by_shape <= 0.7 * len(made)


def test_tables(spark):
    text = "विवरण tarvin@fernhill.example पर भेजें। Call 07700 900123 now."
    d = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text)], "doc_id long, text string").selectExpr("*", "'x' AS kind", "0 AS start_pos")
    assert {(r.kind, text[r.start_pos : r.end_pos]) for r in pii.mentions(d).collect()} == {("email", "tarvin@fernhill.example"), ("phone", "07700 900123")}
    assert [r.redacted for r in pii.redacted(d).collect()] == ["विवरण [EMAIL] पर भेजें। Call [PHONE] now."]
    assert pii.mentions(d.limit(0)).collect() == []
