"""Plain Python versions of the operators, one document or pair at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from statistics import fmean, pvariance

import regex

from maskmix.llm import mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    return [(k, m.start(), m.end(), m[0]) for k, (p, good) in KINDS.items() for m in re.finditer(p, text) if good(m[0])]


def terms_of(text):
    return [(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]


def disclosing(texts, generalise_at=0.75, remove_at=0.9):
    """``text -> [(start, end, action)]`` of the telling terms, from all texts (None included)."""
    different = set(texts)
    n_all, n_term = len(different), Counter()
    for t in different:
        n_term.update({w for w, _, _ in terms_of(t or "")})
    entities = defaultdict(set)
    for t in different:
        for k, _, _, m in base_spans(t or ""):
            entities[k, re.sub("[^0-9]", "", m) if k in ("card", "phone") else m.lower()].add(t)
    told = defaultdict(dict)
    for holders in entities.values():
        n_entity = len(holders)
        n_both = Counter(w for t in holders for w in {x for x, _, _ in terms_of(t)})
        content = math.log2(n_all / n_entity)
        for w, n in n_both.items():
            of, p = n_term[w], n / n_term[w]
            spread = math.sqrt(max(p * (1 - p), 0.0) / of + pii.Z**2 / (4 * of * of))
            low = (p + pii.Z**2 / (2 * of) - pii.Z * spread) / (1 + pii.Z**2 / of)
            share = (math.log2(low) + content) / content if content > 0 else 0.0
            if share >= generalise_at:
                for t in holders:
                    if w in {x for x, _, _ in terms_of(t)}:
                        told[t][w] = max(told[t].get(w, ""), "removed" if share >= remove_at else "generalised")
    out = {}
    for t, words in told.items():
        base = base_spans(t)
        out[t] = [(s, e, words[w]) for w, s, e in terms_of(t) if w in words and not any(a < e and s < b for _, a, b, _ in base)]
    return out


def sanitised(text, extra):
    if text is None:
        return None
    spans = [(s, e, f"[{k}]") for k, s, e, _ in base_spans(text)]
    spans += [(s, e, "" if action == "removed" else "[number]" if text[s] in "0123456789" else "[name]" if regex.match(r"\p{Lu}", text[s]) else "[word]") for s, e, action in extra]
    out, at, merged = [], 0, []
    for s, e, r in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e), merged[-1][2])
        else:
            merged.append((s, e, r))
    for s, e, r in merged:
        out += [text[at:s], r]
        at = e
    return "".join(out) + text[at:]


def measures(text):
    words = WORD.findall(text or "")
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def good(rows):
    """``(base_failed, kept)`` of each (text, host)."""
    judged = []
    for text, host in rows:
        n, chars, symbols, dup, repeated = measures(text)
        base = n < 10 or 100 * repeated > 20 * n
        judged.append((host, base, base or 100 * symbols > 10 * chars or 100 * dup > 30 * n))
    hosts = defaultdict(list)
    for host, _, failed in judged:
        hosts[host].append(failed)
    rates = [fmean(v) for v in hosts.values()]
    m, v = (fmean(rates), pvariance(rates)) if rates else (0, 0)
    k = max(1.0, min(1000.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    ok = {h: (sum(f) + m * k) / (len(f) + k) <= quality.HOST_LIMIT for h, f in hosts.items()}
    return [(base, not base and ok[host]) for host, base, _ in judged]


def shares(rows):
    """``(size, source_size, target, [words taken of each copy], offset, demand, rates)`` of each (id, text, source)."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    totals = Counter()
    for (_, _, source), n in zip(rows, sizes, strict=True):
        totals[source] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes)
    while open_:
        pool = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / pool > 2 * totals[s]}
        if not over:
            target |= {s: left * weight[s] / pool for s in open_}
            break
        target |= {s: 2.0 * totals[s] for s in over}
        left -= sum(2.0 * totals[s] for s in over)
        open_ -= over
    rates = {s: mixing.SCHEDULES[i % 3] for i, s in enumerate(names)}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda i: md5(str(rows[i][0]) if rows[i][0] is not None else "text:" + md5(rows[i][1] or ""))
    at, out = Counter(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (key(i), sizes[i])):
        source, n = rows[i][2], sizes[i]
        demand, o = math.floor(target[source] + 0.5), at[source]
        taken = [max(0, min(n, demand - k * totals[source] - o)) for k in (0, 1)]
        out[i] = (n, totals[source], target[source], taken, o, demand, rates[source])
        at[source] += n
    return out
