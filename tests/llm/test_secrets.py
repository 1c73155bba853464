"""op1: base spans against a plain restatement, the network's held-out recall and precision, odd rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import secrets


def plain_base(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", '"', "abcdef01", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "x.", "-"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_base(text)


def words(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(400)]


@pytest.fixture(scope="module")
def model():
    config = secrets.SecretConfig()
    net = secrets.CharacterConvolution(config)
    made = secrets.made_up_examples(random.Random(5), words(1), 3000)
    return net.fit(np.array([net.view(t, s, e) for t, s, e, _ in made]), np.array([y for *_, y in made], float))


def test_held_out_findings(model):
    made = secrets.made_up_examples(random.Random(99), words(2), 1000)
    p = model.probabilities(np.array([model.view(t, s, e) for t, s, e, _ in made])) >= model.thresholds[-1]
    y = np.array([x[3] for x in made]) == 1
    assert p[y].mean() > 0.95 and p[~y].mean() < 0.03


def test_slopes_are_those_of_the_loss():
    net = secrets.CharacterConvolution(secrets.SecretConfig(filters=5, embedding=3))
    made = secrets.made_up_examples(random.Random(2), ["a", "b"], 6)
    views, y = np.array([net.view(t, s, e) for t, s, e, _ in made]), np.array([x[3] for x in made], float)
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.logits(views)) - y * z))
    slopes, rng = net.slopes(views, y), np.random.default_rng(1)
    for name, w in net.weights.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            down = loss()
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - slopes[name][at]) < 1e-4


def test_scan_and_redaction(spark, model):
    key = "ghp_" + "aB3dE6gH9" * 4
    texts = ["", None, "plain words only", f"é password = \"{'a1' * 10}\" and {key} end", "0123456789abcdef" * 20, "token: " + "f" * 40, "x " * 60000 + "AKIA" + "A" * 16, "mail to ann.12@mail7.example.com or 4539578763621486 now"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "secret=12345678"), (3, texts[3])], "doc_id long, text string").selectExpr("*", "1 as secret_spans", "2 as redacted", "3 as kind")
    rows = secrets.scan_secrets(docs, model, ["doc_id"], replacement="[SECRET]").collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in got[i].secret_spans]
        assert [s for s in spans if s[0] != "network"] == plain_base(text or "")
    assert got[1].redacted is None and got[2].redacted == texts[2] and got[7].redacted == texts[7]
    assert key not in got[3].redacted and "a1a1" not in got[3].redacted and got[3].redacted.startswith("é [SECRET]") and got[3].redacted.endswith(" end")
    assert got[5].redacted == "[SECRET]" and got[6].redacted == "x " * 60000 + "[SECRET]"
    assert secrets.scan_secrets(docs.limit(0), model, ["doc_id"]).count() == 0


def test_training_on_documents(spark):
    docs = spark.createDataFrame([(i, f"word {i} password={'ab12' * 4} and more") for i in range(30)], "doc_id long, text string")
    small = secrets.SecretConfig(made_up=300, epochs=2)
    for some in (docs, docs.limit(0)):
        net = secrets.train_scanner(some, small)
        assert len(net.thresholds) == len(secrets.SHAPES) and ((net.thresholds > 0) & (net.thresholds < 1)).all() and 0 <= net.recall <= 1


def test_keys_deep_in_a_run(spark):
    """A key that begins behind the 40th character of its run is found; windows hold every character of a run once or more."""
    rng = random.Random(8)
    pick = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(3, 8)))
    net = secrets.train_scanner(spark.createDataFrame([(i, " ".join(name() for _ in range(60))) for i in range(30)], "doc_id long, text string"))
    hooks = [f"see https://hooks.slack.com/services/T{rng.randint(10**7, 10**8)}A/B{rng.randint(10**7, 10**8)}A/{pick(24)} there" for _ in range(100)]
    ends = ["at /" + "/".join(name() for _ in range(400)) + "/" + pick(40) + " here" for _ in range(50)]
    plain = ["at /" + "/".join(name() for _ in range(rng.randint(9, 20))) + "/7 here" for _ in range(100)]
    share = lambda texts: np.mean([any(kind == "network" for kind, *_ in secrets.all_spans(t, net)) for t in texts])
    assert share(hooks) >= 0.95 and share(ends) >= 0.95 and share(plain) <= 0.1
    for n in (1, 16, 40, 41, 49, 50, 51, 300):
        at = net.places(7, 7 + n)
        assert {p for a in at.tolist() for p in range(a, min(a + 40, 7 + n))} == set(range(7, 7 + n)) and len(set(at.tolist())) == len(at)
    long = "".join(rng.choice("ab1/") for _ in range(90_000))
    assert net.likeliest(long, [(0, 90_000), (5, 30)]).tolist() == pytest.approx([net.probabilities(net.windows(long, 0, 90_000)).max(), net.probabilities(net.windows(long, 5, 30)).max()])


def test_recall_is_of_what_the_threshold_decides(spark, monkeypatch):
    """Findings of base patterns don't count for the threshold, and keys of known formats are no negatives."""
    seen = {}
    fit = secrets.CharacterConvolution.fit

    def spy(self, views, labels, owners=None, base=None, shapes=None):
        seen.update(views=views, labels=labels, owners=owners, base=base)
        return fit(self, views, labels, owners, base, shapes)

    monkeypatch.setattr(secrets.CharacterConvolution, "fit", spy)
    rng = random.Random(3)
    keys = ["ghp_" + "aB3dE6gH9" * 4, "sk-" + "aB3dE6gH" * 5, "eyJ" + "hbGciOi" * 4 + "." + "eyJzdWIi" * 5 + "." + "aB3_" * 10, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    rows = [(i, f"some words {keys[i % 4]} and /usr/lib/x{i}/some.name.{i} then password={rng.randrange(16**15):016x} end") for i in range(200)]
    net = secrets.train_scanner(spark.createDataFrame(rows, "doc_id long, text string"), secrets.SecretConfig(made_up=600, epochs=3))
    views = {net.view(k and f"some words {k} and /usr/lib/x", 11, 11 + len(k))[24:64].tobytes() for k in keys}
    assert not [v for v, y in zip(seen["views"], seen["labels"], strict=True) if y == 0 and v[24:64].tobytes() in views]
    assert seen["base"].sum() >= 200 and (~seen["base"]).sum() >= 400 and len(seen["base"]) == seen["owners"].max() + 1
    # with base findings at 1 and others at 0.7 the threshold follows the others
    logits, truth = np.r_[np.full(900, 9.0), np.full(100, 0.7)], np.ones(1000)
    monkeypatch.setattr(net, "logits", lambda v: v[:, 0])
    monkeypatch.setattr(secrets, "calibrate", lambda *a: (1.0, 0.0))
    monkeypatch.setattr(net, "slopes", lambda *a: {})
    fit(net, logits[:, None], truth, np.arange(1000), logits > 1)
    assert net.thresholds == pytest.approx(secrets.sigmoid(np.array([0.7] * 4))) and net.recall == 1.0
    # a threshold below a half stays where the recall asks for it, and each shape has its own
    low = np.where(np.arange(1000) % 2, -1.0, 2.0)
    fit(net, low[:, None], truth, np.arange(1000), np.zeros(1000, bool), np.where(low < 0, 0, 3))
    assert net.thresholds[[0, 3]] == pytest.approx(secrets.sigmoid(np.array([-1.0, 2.0]))) and net.recall == 1.0


def test_beside_base_spans(spark):
    """What a base span leaves of a run is a candidate; plain restatement: mask the base spans, then look for runs."""
    rng = random.Random(4)
    parts = ["0123456789abcdef" * 2, "AKIA" + "B" * 16, "token=", "ghp_aB3dE6gH9aB3dE6gH9", "/", "-x9Y", " ", "zz", "é", "QwErTyUi12345678"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        found = secrets.base_spans(text)
        masked = list(text)
        for _, s, e in found:
            masked[s:e] = " " * (e - s)
        masked = "".join(masked)
        assert secrets.candidates(text, found) == secrets.candidates(masked, [])


def test_formats_left_out_of_training(spark):
    """Recall on formats of keys that training has not seen, and the look-alikes let through."""
    docs = spark.createDataFrame([(i, " ".join(words(i)[:60])) for i in range(30)], "doc_id long, text string")
    caught, asked, wrong, plain = 0, 0, 0, 0
    for left_out in ((0, 1), (2, 3), (4,)):
        net = secrets.train_scanner(docs, kinds=tuple(i for i in range(8) if i not in left_out))
        for text, start, end, label in secrets.made_up_examples(random.Random(77), words(3), 600, left_out):
            hit = any(k == "network" and s < end and start < e for k, s, e in secrets.all_spans(text, net))
            caught, asked, wrong, plain = caught + hit * label, asked + label, wrong + hit * (1 - label), plain + 1 - label
    print(f"recall on formats left out {caught / asked:.3f}, look-alikes let through {wrong / plain:.3f}")
    assert caught / asked >= 0.9 and wrong / plain <= 0.1
