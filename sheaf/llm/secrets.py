"""Secret scans: base patterns, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled
from .nets import Adam, calibrate, sigmoid

#: The base kinds in their order, their patterns, the group that has the secret and its least length.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Runs of 32 hex digits or more are the runs that stay after the length test.
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
KINDS = [kind for kind, *_ in BASE] + ["network"]
#: What else the network looks at: long runs of the characters that keys are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Known key formats: a candidate of the sample that has one is no example of a harmless run.
KEY_FORMAT = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{10,}|[sr]k[-_][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|AIza[A-Za-z0-9_-]{30,}|npm_[A-Za-z0-9]{20,}|SG\.[A-Za-z0-9_-]{16,}|hooks\.slack\.com/services/"
    r"|(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, leftmost and non-overlapping within each kind."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of 16 characters or more with a digit, or with both cases and a sign, and what base spans leave of such runs.
    taken: the base spans, by start."""
    held: list[list[int]] = []
    for _, s, e in taken:
        if held and s <= held[-1][1]:
            held[-1][1] = max(held[-1][1], e)
        else:
            held.append([s, e])
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(held) and held[k][1] <= at:
            k += 1
        i = k
        while at < end:
            to = min(end, held[i][0]) if i < len(held) else end
            if to - at >= 16:
                run = text[at:to]
                if any(c.isdigit() for c in run) or (not run.isalpha() and run.lower() != run and run.upper() != run):
                    out.append((at, to))
            at = held[i][1] if i < len(held) else end
            i += 1
    return out


#: What a candidate looks like; each shape has its own threshold.
SHAPES = ("hexadecimal", "digits and signs", "long", "mixed")


def shape(run: str, inside: int) -> int:
    """The number of a candidate's shape: hexadecimal digits alone; no letters; more than the network sees at once; the
    rest."""
    if re.fullmatch(r"[0-9a-fA-F]+", run) and not run.isdigit():
        return 0
    if not re.search("[A-Za-z]", run):
        return 1
    return 2 if len(run) > inside else 3


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@dataclass(frozen=True)
class SecretConfig:
    """The network sees `inside` characters of a candidate, `before` in front of them and `after` behind. Of longer
    candidates it sees overlapping windows, one every `stride` characters and one at the end, and the likeliest counts.

    Training takes the findings and candidates of at most sample_rows documents, chosen by a hash of their ids and of
    up to sample_chars characters each, and made_up findings and look-alikes of public formats besides. Of the
    candidates a twentieth calibrates, three set the thresholds, one is kept for the model's `recall` and `false_share`;
    the rest is trained on. Each shape of candidates has the highest threshold that keeps least_recall of the true findings
    that no base pattern makes, whatever look-alikes that lets pass; shapes without such findings have that of all, or 0.5 if it is
    lower.
    """

    before: int = 24
    inside: int = 40
    after: int = 8
    stride: int = 10
    embedding: int = 6
    width: int = 5
    filters: int = 24
    sample_rows: int = 3000
    sample_chars: int = 20_000
    made_up: int = 3000
    least_recall: float = 0.99
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 1


class CharacterConvolution:
    """embedding -> convolution -> ReLU -> max over each of the three parts of the view -> logit -> calibration."""

    def __init__(self, config: SecretConfig):
        c, rng = config, np.random.default_rng(config.seed)
        self.config = c
        draw = lambda *shape, scale: rng.normal(size=shape) * scale
        self.weights = {"E": draw(130, c.embedding, scale=0.5), "W": draw(c.width * c.embedding, c.filters, scale=0.3), "c": np.zeros(c.filters), "u": draw(3 * c.filters + 2, scale=0.2), "b": np.zeros(1)}
        self.slope, self.offset = 1.0, 0.0
        self.thresholds, self.recall, self.false_share = np.ones(len(SHAPES)), None, None
        n = c.before + c.inside + c.after - c.width + 1
        # a filter belongs to the part that its middle is in
        middle = np.arange(n) + c.width // 2
        self.parts = [np.flatnonzero(middle < c.before), np.flatnonzero((middle >= c.before) & (middle < c.before + c.inside)), np.flatnonzero(middle >= c.before + c.inside)]

    def view(self, text: str, start: int, end: int) -> np.ndarray:
        """The first of the candidate's windows."""
        return self.windows(text, start, min(end, start + self.config.inside), end - start)[0]

    def places(self, start: int, end: int) -> np.ndarray:
        """Where the windows of a candidate start: together they hold all of it."""
        last = max(start, end - self.config.inside)
        return np.r_[start : last : self.config.stride, last]

    def windows(self, text: str, start: int, end: int, length: int | None = None) -> np.ndarray:
        """Characters as numbers: ASCII as they are, 128 for any other, 129 for none; then the candidate's length and
        the share of the window's characters that differ. A row for each window."""
        c = self.config
        size = min(c.inside, end - start)
        code = lambda s: np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
        left, own, right = code(text[max(0, start - c.before) : start]), code(text[start:end]), code(text[end : end + c.after])
        row = np.concatenate([np.full(c.before - len(left), 129), left, own, right, np.full(c.after - len(right), 129)]).astype(np.int64)
        at = self.places(start, end)
        seen = row[(at - start)[:, None] + np.arange(c.before + size + c.after)]
        inner = np.sort(seen[:, c.before : c.before + size], 1)
        share = 100 * (1 + (inner[:, 1:] != inner[:, :-1]).sum(1)) // size
        gap = np.full((len(at), c.inside - size), 129)
        return np.concatenate([seen[:, : c.before + size], gap, seen[:, c.before + size :], np.full((len(at), 1), min(length or end - start, 200)), share[:, None]], 1)

    def forward(self, views: np.ndarray):
        c, w = self.config, self.weights
        symbols = views[:, :-2]
        seen = np.lib.stride_tricks.sliding_window_view(w["E"][symbols], c.width, axis=1).transpose(0, 1, 3, 2).reshape(len(views), -1, c.width * c.embedding)
        z = seen @ w["W"] + w["c"]
        at = np.stack([part[z[:, part].argmax(1)] for part in self.parts], 1)  # view, part, filter
        raw = np.take_along_axis(z, at.reshape(len(z), -1, c.filters), 1)
        features = np.concatenate([np.maximum(raw, 0).reshape(len(z), -1), views[:, -2:] / 50.0], 1)
        return seen, at, raw, features, features @ w["u"] + w["b"][0]

    def logits(self, views: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(views[i : i + 512])[-1] for i in range(0, len(views), 512)]) if len(views) else np.zeros(0)

    def probabilities(self, views: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(views) + self.offset)

    def likeliest(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """The highest probability of each candidate's windows, a bounded number of windows at a time."""
        best = np.zeros(len(spans))
        held, owner, n = [], [], 0

        def flush() -> None:
            nonlocal n
            np.maximum.at(best, np.concatenate(owner), self.probabilities(np.concatenate(held)))
            held.clear(), owner.clear()
            n = 0

        c = self.config
        reach = c.stride * 4096  # of very long runs, stretches of so many windows that overlap by one
        for i, (start, end) in enumerate(spans):
            at = start
            while True:
                to = min(end, at + reach + c.inside)
                views = self.windows(text, at, to, end - start)
                held.append(views)
                owner.append(np.full(len(views), i))
                n += len(views)
                if n >= 4096:
                    flush()
                if to == end:
                    break
                at += reach
        if held:
            flush()
        return best

    def slopes(self, views: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        c, w = self.config, self.weights
        seen, at, raw, features, logit = self.forward(views)
        error = (sigmoid(logit) - labels) / len(labels)
        d = (error[:, None] * w["u"][None, :-2]).reshape(raw.shape) * (raw > 0)
        row = np.arange(len(views))[:, None, None]
        picked = seen[row, at]  # view, part, filter, window
        d_seen = (d[..., None] * w["W"].T[None, None]).reshape(-1, c.width, c.embedding)
        symbols = views[row[..., None], at[..., None] + np.arange(c.width)].reshape(-1, c.width)
        d_e = np.stack([np.bincount(symbols.ravel(), d_seen[:, :, e].ravel(), 130) for e in range(c.embedding)], 1)
        return {"u": features.T @ error, "b": error.sum(keepdims=True), "W": np.einsum("npf,npfw->wf", d, picked), "c": d.sum((0, 1)), "E": d_e}

    def fit(self, views: np.ndarray, labels: np.ndarray, owners: np.ndarray | None = None, base: np.ndarray | None = None, shapes: np.ndarray | None = None) -> CharacterConvolution:
        """owners: the number of each view's candidate, from 0; a candidate is held out, and counts, as a whole. base:
        by candidate, whether a base pattern finds it, so that the threshold never decides on it. shapes: by candidate."""
        c, rng = self.config, np.random.default_rng(self.config.seed)
        owners = np.arange(len(views)) if owners is None else owners
        total = int(owners.max()) + 1
        order = rng.permutation(total)
        part = np.zeros(total, int)  # 0 trains, 1 calibrates, 2 sets thresholds, 3 reports
        for name, share in ((1, (0, 1)), (2, (1, 4)), (3, (4, 5))):
            part[order[share[0] * total // 20 : share[1] * total // 20]] = name
        base = np.zeros(total, bool) if base is None else base
        shapes = np.full(total, len(SHAPES) - 1) if shapes is None else shapes
        train, check = np.flatnonzero(part[owners] == 0), np.flatnonzero(part[owners] > 0)
        steps = Adam(self.weights, c.rate)
        for epoch in range(c.epochs):
            steps.rate = c.rate * (1 - epoch / c.epochs)
            for some in np.array_split(rng.permutation(train), max(1, len(train) // c.batch)):
                steps.update(self.slopes(views[some], labels[some]))
        logits, truth = np.full(total, -np.inf), np.zeros(total)
        np.maximum.at(logits, owners[check], self.logits(views[check]))
        np.maximum.at(truth, owners[check], labels[check])
        self.slope, self.offset = calibrate(logits[part == 1], truth[part == 1])
        score = sigmoid(self.slope * logits + self.offset)
        asked = (part == 2) & (truth > 0.5) & ~base

        def highest(which: np.ndarray, otherwise: float) -> float:
            """The highest threshold that keeps the recall of these findings."""
            true = np.sort(score[which])
            return float(true[int((1 - c.least_recall) * len(true))]) if len(true) else otherwise

        every = highest(asked, 0.5)
        self.thresholds = np.array([highest(asked & (shapes == i), max(0.5, every)) for i in range(len(SHAPES))])
        passed = score >= self.thresholds[shapes]
        true, false = (part == 3) & (truth > 0.5) & ~base, (part == 3) & (truth < 0.5)
        self.recall = float(passed[true].mean()) if true.any() else None
        self.false_share = float(passed[false].mean()) if false.any() else None
        return self

    def found(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The candidates whose likeliest window reaches the threshold of their shape."""
        if not spans:
            return []
        kinds = [shape(text[s:e], self.config.inside) for s, e in spans]
        return [span for span, yes in zip(spans, self.likeliest(text, spans) >= self.thresholds[kinds], strict=True) if yes]


def made_up_examples(rng: random.Random, context: list[str], n: int, kinds: tuple[int, ...] | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): findings and look-alikes in public formats, between words of the given contexts.
    kinds: the numbers of the formats of findings to use, all if None."""
    alnum, hexa, b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(context)
    plain = lambda: re.sub("[^a-z]", "", word().lower()) or "word"
    secret = [
        lambda: ("", "ghp_" + pick(alnum, 36), ""),
        lambda: ("", "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24), ""),
        lambda: ("", "sk-" + pick(alnum, rng.randint(32, 48)), ""),
        lambda: ("", "eyJ" + pick(alnum, 33) + "." + pick(alnum + "-_", 60) + "." + pick(alnum + "-_", 43), ""),
        lambda: (rng.choice(["aws_secret_access_key = ", "key: ", "SECRET_ACCESS_KEY=", "Authorization: Bearer ", "private key ", "credential="]), pick(b64, 40), ""),
        lambda: (rng.choice(["api-key: ", "auth=", "pwd=", "key=", "access_key="]), pick(rng.choice([hexa, alnum]), rng.randint(16, 64)), rng.choice(["", ";", '"'])),
        lambda: ("", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ""),
        lambda: (rng.choice(["token = ", "password=", 'secret: "']), pick(hexa, rng.choice([18, 32, 40])), ""),
    ]
    secret = secret if kinds is None else [secret[i] for i in kinds]
    harmless = [
        lambda: ("", pick("0123456789", rng.randint(16, 19)), ""),
        lambda: (f"{plain()}.{rng.randint(1, 99)}@", f"mail{rng.randint(0, 99)}.{plain()[:8]}.{rng.choice(['com', 'org', 'net'])}", ""),
        lambda: ("https:/", "/" + "/".join([f"www.{plain()}.org", plain(), plain(), str(rng.randint(1, 2030))]), ""),
        lambda: ("", f"{plain()}-{plain()}-{plain()}-{rng.randint(1, 99)}", ""),
        lambda: ("", f"/usr/lib/{plain()}/{plain()}_{rng.randint(1, 9)}.{rng.randint(0, 20)}.so", ""),
        lambda: ("", f"2{rng.randint(0, 999):03}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}-00-00.000", ""),
        lambda: ("", f"{plain()}_{plain()}_v{rng.randint(1, 9)}.tar.gz", ""),
        lambda: ("", "-" * rng.randint(16, 40) + str(rng.randint(0, 9)), ""),
        lambda: ("", rng.choice("ABCx0.=_") * rng.randint(16, 40) + str(rng.randint(0, 9)), ""),
        lambda: ("", f"{plain().capitalize()}{plain().capitalize()}{plain().capitalize()}Factory{rng.randint(1, 9)}", ""),
        lambda: ("+", f"{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(10**6, 10**7)}", ""),
        lambda: ("", f"{plain()}={plain()}.{plain()}.{rng.randint(0, 99)}", ""),
        lambda: ("https:/", "/" + rng.choice("/.-_").join(plain() for _ in range(rng.randint(8, 24))) + f"/{rng.randint(1, 2030)}", ""),
    ]
    # runs that a key stands in, behind 40 characters or more, as (lead, what the run begins with, key)
    deep = [
        lambda: ("https:", f"//hooks.slack.com/services/T{pick(alnum[:26], 8)}/B{pick(alnum[:26], 8)}/", pick(alnum, 24)),
        lambda: ("", "/" + "/".join(plain() for _ in range(rng.randint(8, 20))) + "/", pick(rng.choice([hexa, alnum]), rng.randint(24, 48))),
        lambda: ("", ".".join(plain() for _ in range(rng.randint(8, 20))) + "=", rng.choice(["ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 40), pick(alnum, 32)])),
    ]
    out = []
    for i in range(n):
        if i % 10 == 0:
            lead, before, key = rng.choice(deep)()
            left = " ".join(word() for _ in range(5)) + rng.choice([" ", "\n", "("])
            start = len(left) + len(lead) + len(before)
            out.append((f"{left}{lead}{before}{key} {word()} {word()}", start, start + len(key), 1))
            continue
        lead, run, tail = rng.choice(harmless if i % 2 else secret)()
        left = " ".join(word() for _ in range(5)) + rng.choice([" ", " ", "\n", "("])
        out.append((f"{left}{lead}{run}{tail} {word()} {word()}", len(left) + len(lead), len(left) + len(lead) + len(run), 1 - i % 2))
    return out


def train_scanner(docs: DataFrame, config: SecretConfig | None = None, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[int, ...] | None = None) -> CharacterConvolution:
    """Fits the network on a bounded sample: what the base patterns find in it are findings, its other candidates are
    not, but for those of a known key format and those beside a finding, which are left out; both are joined by made-up
    ones (kinds: of these formats alone), which alone are used if there are no documents."""
    config = config or SecretConfig()
    model, rng = CharacterConvolution(config), random.Random(config.seed)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= config.sample_chars)
    texts = [r.text for r in sampled(source, F.xxhash64("id", F.lit(3)), config.sample_rows, docs.count()).collect()]
    views, labels, owners, base, shapes, words, n = [], [], [], [], [], set(), 0

    def add(text: str, start: int, end: int, label: int, known: bool | None = None) -> None:
        """A candidate's windows; around a key within a run, those that hold at least 20 characters of it or none."""
        nonlocal n
        run = next((m.span() for m in CANDIDATE.finditer(text) if m.start() <= start and end <= m.end()), (start, end)) if label else (start, end)
        rows, at = model.windows(text, *run), model.places(*run)
        shared = np.minimum(at + config.inside, end) - np.maximum(at, start)
        true = (shared >= min(20, end - start)) * label
        use = (true == label) | (shared <= 0)
        views.append(rows[use])
        labels.append(true[use])
        owners.append(np.full(int(use.sum()), n))
        base.append(any(s < run[1] and run[0] < e for _, s, e in base_spans(text)) if known is None else known)
        shapes.append(shape(text[run[0] : run[1]], config.inside))
        n += 1

    for text in texts:
        found = base_spans(text)
        for kind, start, end in found:
            run = CANDIDATE.search(text, start, end) if kind == "assign" else None
            add(text, *(run.span() if run else (start, end)), 1, True)
        for start, end in candidates(text, found):
            if not KEY_FORMAT.search(text, start, end) and not any(s == end or e == start for _, s, e in found):
                add(text, start, end, 0, False)
        if len(words) < 20_000:
            words.update(text.split()[:200])
    for text, start, end, label in made_up_examples(rng, sorted(words) or ["some", "words", "here"], config.made_up, kinds):
        add(text, start, end, label)
    return model.fit(np.concatenate(views), np.concatenate(labels).astype(float), np.concatenate(owners), np.array(base), np.array(shapes))


def all_spans(text: str, model: CharacterConvolution | None) -> list[Span]:
    """The base spans and, as kind `network`, the candidates that the network finds."""
    found = base_spans(text)
    if model is None:
        return found
    return in_order(found + [("network", s, e) for s, e in model.found(text, candidates(text, found))])


SPAN_TYPE = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, model: CharacterConvolution | None, columns: list[str], text_col: str = "text", replacement: str | None = None, spans_col: str = "secret_spans", redacted_col: str = "redacted") -> DataFrame:
    """The given columns and spans_col, array<struct<kind, start, end>> in code points, of each row's whole text.

    With a replacement, also redacted_col: the text with each union of overlapping spans replaced by it. Null texts count
    as empty and have no spans. Rows stay as they are, repeated ones too; no shuffle. Given columns that have one of the
    two names give way.
    """
    columns = [c for c in columns if c != spans_col and (c != redacted_col or replacement is None)]
    n, at_text = len(columns), columns.index(text_col) if text_col in columns else len(columns)
    names = [*columns, spans_col] + [redacted_col] * (replacement is not None)

    def redact(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        end = -1
        for _, s, e in spans:
            if s >= end:
                if end >= 0:
                    out.append(replacement)
                    at = end
                out.append(text[at:s])
                end = e
            else:
                end = max(end, e)
        if end < 0:
            return text
        return "".join([*out, replacement, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans, clean = [], []
                for text in part.column(at_text).to_pylist():
                    found = all_spans(text or "", model)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                    if replacement is not None:
                        clean.append(None if text is None else redact(text, found))
                extra = [pa.array(clean, pa.string())] if replacement is not None else []
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(spans, SPANS), *extra], names)

    source = docs.select(*columns, *[text_col] * (at_text == n))
    schema = docs.select(*columns).schema.add(spans_col, SPAN_TYPE)
    return source.mapInArrow(run, schema.add(redacted_col, "string") if replacement is not None else schema)
