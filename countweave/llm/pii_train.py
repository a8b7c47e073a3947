"""Training of the personal-information tagger: `python -m countweave.llm.pii_train` writes its file.

The chain's tables are fitted by gradient ascent on the likelihood of generated texts (pii_lines,
seeded). With these kept, the potentials of the skip edges are fitted on further texts: the gradient
is the share of linked pairs whose labels agree less the share that loopy message passing expects.
Deterministic for a given numpy; about half a minute.
"""

from __future__ import annotations

import numpy as np

from countweave.llm import pii, pii_lines
from countweave.llm.pii import K, LABELS, Documents, Model
from countweave.llm.pii_text import fold, tokens

SAMPLES, EPOCHS, SEED, KEEP = 6000, 40, 7, 0.3


def gathered(lexicon, lines, vocabulary: dict[str, int]) -> tuple[Documents, np.ndarray]:
    """The texts as one batch of documents, and the labels of all their tokens."""
    doc = Documents(lexicon, vocabulary)
    gold: list[int] = []
    for text, spans in lines:
        bounds = doc.add(text, whole=True)
        y = [0] * len(bounds)
        for kind, a, e in spans:
            first = True
            for t, (ts, te) in enumerate(bounds):
                if ts >= a and te <= e:
                    y[t] = LABELS.index(kind) if kind in ("E", "P", "D") else LABELS.index(("B" if first else "I") + kind)
                    first = False
        gold += y
    return doc, np.array(gold)


def fit_chain(lexicon, lines, epochs: int = EPOCHS) -> Model:
    words: dict[str, int] = {}
    for text, spans in lines:
        inside = np.zeros(len(text) + 1, dtype=bool)
        for _, a, e in spans:
            inside[a:e] = True
        for kind, a, _, s in tokens(text):
            if kind == "word" and not inside[a]:
                words[fold(s)] = words.get(fold(s), 0) + 1
    cue = sorted(w for w, n in words.items() if n >= 8 and not lexicon.is_given(w) and not lexicon.is_family(w) and not lexicon.is_morph(w))
    model = Model({w: i + 1 for i, w in enumerate(cue)})
    doc, truth = gathered(lexicon, lines, model.vocabulary)
    b = doc.batch()
    hot = np.zeros((b.n, K))
    hot[np.arange(b.n), truth] = 1
    seen = np.zeros((K, K))
    for box in b.groups:
        live = box[:, 1:] >= 0
        np.add.at(seen, (truth[box[:, :-1][live]], truth[box[:, 1:][live]]), 1)
    g2 = {k: np.full_like(t, 1e-6) for k, t in model.tables.items()}
    e2 = np.full((K, K), 1e-6)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        # what stands around a token is left out at random, so that its own form speaks for itself
        taken = {k: slice(None) if k == "c0" else np.flatnonzero(rng.random(b.n) < KEEP) for k in b.features}
        s = np.zeros((b.n, K))
        for k, i in b.features.items():
            s[taken[k]] += model.tables[k][i[taken[k]]]
        psi, a = np.exp(s - s.max(1, keepdims=True)), model.transitions()
        m, pairs = np.zeros((b.n, K)), np.zeros((K, K))
        for box in b.groups:
            got, p, _ = pii.chain(box, psi, a, gradient=True)
            live = box >= 0
            m[box[live]] = got[live]
            pairs += p
        diff = hot - m
        for k, i in b.features.items():
            i, d = i[taken[k]], diff[taken[k]]
            g = np.stack([np.bincount(i, weights=d[:, c], minlength=len(model.tables[k])) for c in range(K)], 1) - (1.0 if k in "tuv" else 0.02 if k == "c0" else 0.3) * model.tables[k]
            g2[k] += g * g
            model.tables[k] += 0.35 * g / np.sqrt(g2[k])
        g = seen - pairs - 0.1 * model.edges
        e2 += g * g
        model.edges += 0.35 * g / np.sqrt(e2)
    return model


def fit_skips(model: Model, lexicon, lines, steps: int = 25) -> None:
    doc, truth = gathered(lexicon, lines, model.vocabulary)
    b, links = doc.batch(), doc.links()
    i, j, kind = links
    groups = np.stack([pii.BOTH_O, pii.SAME]).astype(float)
    seen = groups[:, truth[i], truth[j]]
    g2 = np.full((2, 2), 1e-6)
    for _ in range(steps):
        _, at_i, at_j, agree = model.messages(b, links)
        belief = at_i[:, :, None] * agree * at_j[:, None, :]
        belief /= belief.sum((1, 2), keepdims=True)
        expected = np.einsum("lxy,gxy->gl", belief, groups)
        for k in (pii.EQUAL, pii.SIMILAR):
            g = (seen - expected)[:, kind == k].sum(1) - 0.3 * model.skip[k]
            g2[k] += g * g
            model.skip[k] += 0.3 * g / np.sqrt(g2[k])


def fit(samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    lexicon, lines = pii_lines.sample(samples, seed)
    model = fit_chain(lexicon, lines, epochs)
    fit_skips(model, *pii_lines.sample(samples // 3, seed + 1))
    return model


def save(model: Model, path) -> None:
    out = {"words": np.array(sorted(model.vocabulary, key=model.vocabulary.get)), "edges": model.edges, "skip": model.skip}
    for k, t in model.tables.items():
        at = np.flatnonzero(np.abs(t).max(1) > 0)
        out |= {f"at_{k}": at.astype(np.int32), f"w_{k}": t[at].astype(np.float32)}
    np.savez_compressed(path, **out)


if __name__ == "__main__":
    save(fit(), pii.FITTED)
    print(pii.FITTED, pii.FITTED.stat().st_size, "bytes; skip potentials", pii.trained().skip.round(3).tolist())
