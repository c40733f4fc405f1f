"""Plain versions of the operators, row by row, to hold results against."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def line_dedup(rows):
    """rows: (doc_id, text), ids distinct."""
    holders = defaultdict(set)
    keyed = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        keyed[doc] = [(x, lower(x.strip(SPACE))) for x in lines]
        for _, k in keyed[doc]:
            if len(k) >= 10:
                holders[k].add(doc)
    out = []
    for doc, lines in keyed.items():
        kept = [x for x, k in lines if not (len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def exact_dedup(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(f"[{SPACE}]", "", text or "")].append((-len(text or ""), doc))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(doc, keep, len(members), doc == keep, sha(norm)) for _, doc in members]
    return out


def shingles(text, size=5):
    words = re.findall(f"[^{SPACE}]+", lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_dedup(rows, percent=85):
    sets = {doc: shingles(text) for doc, text in rows}
    holders = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    common = Counter()
    for docs in holders.values():
        docs.sort()
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                common[a, b] += 1
    label = {doc: doc for doc in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            label[b] = a
    return [(doc, len(s), find(doc), find(doc) == doc) for doc, s in sets.items()]


def measures(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def binomial_tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))))


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def exact_tail(k, n, p):
    """P(X <= k) by exact sums of logarithms: for large n too."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


#: Each rule's measure, whether it rejects below, and its cutoffs from lenient to strict.
RULES = [
    (lambda m: m[2] / max(m[1], 1), False, [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    (lambda m: m[3] / max(m[5], 1), False, [x / 100 for x in range(90, 10, -5)]),
    (lambda m: m[4] / max(m[0], 1), False, [x / 100 for x in range(48, 4, -4)]),
    (lambda m: m[1] / max(m[0], 1), False, [x / 2 for x in range(40, 11, -1)]),
    (lambda m: m[1] / max(m[0], 1), True, [x / 4 for x in range(4, 17)]),
]


def quality(rows, labels, risk=0.02, error=0.05):
    """{doc_id: kept} of rows (doc_id, text, stratum), ids distinct; labels: (doc_id, quality)."""
    told = {d: (*measures(t), (t or "").count("\n") + 1) for d, t, _ in rows}
    passed = {d for d, m in told.items() if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    chain = sorted(((i + 1) / len(cut), r, i) for r, (_, _, cut) in enumerate(RULES) for i in range(len(cut)))

    def first_rejecting(m):
        for at, (_, r, i) in enumerate(chain):
            value, below, cut = RULES[r]
            if value(m) < cut[i] if below else value(m) > cut[i]:
                return at
        return len(chain)

    best = {}
    for d, q in labels:
        if d is not None and q is not None:
            best[d] = max(best.get(d, 0), q)
    trials = {}
    for d, t, s in rows:
        if d in passed and d in best:
            trials[s, t] = max(trials.get((s, t), 0), best[d])
    good = defaultdict(list)
    for (s, t), q in trials.items():
        if q == 1:
            d = next(x for x, u, v in rows if (v, u) == (s, t))
            good[s].append(first_rejecting(told[d]))
    least = math.ceil(math.log(error / max(len(good), 1)) / math.log(1 - risk))
    tested = defaultdict(list)
    for s, places in good.items():
        tested[s if len(places) >= least else "pooled"] += places
    cutoffs = {}
    for s in good:
        group = s if len(good[s]) >= least else "pooled"
        places, n = tested[group], len(tested[group])
        steps = 0
        while steps < len(chain) and exact_tail(sum(p <= steps for p in places), n, risk) <= error / len(tested):
            steps += 1
        cutoffs[s] = steps
    return {d: d in passed and first_rejecting(told[d]) >= cutoffs.get(s, 0) for d, _, s in rows}


def secret_spans(text):
    """(kind, start, end) of all spans, by looking at every character and every window anew."""
    text = text or ""
    base = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    covered = bytearray(len(text))
    for a, _, b in base:
        covered[a:b] = b"\x01" * (b - a)
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    digits = set("0123456789")
    allowed = (r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", r"[0-9_=+/-]+", r"([A-Za-z]+|[0-9]{1,4})([-_/]([A-Za-z]+|[0-9]{1,4}))+", r"(sha(1|256|384|512)|md5)-[A-Za-z0-9+/=]+")
    harmless = lambda s: any(re.fullmatch(a, s) for a in allowed)
    found, i = list(base), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in letters:
            j += 1
        if j - i >= 20 and not harmless(text[i:j]):
            a = i
            while a < j:
                b = a
                while b < j and covered[b] == covered[a]:
                    b += 1
                s = text[a:b]
                plain = not digits & set(s) and all(re.fullmatch(r"[A-Z]?[a-z]+([A-Z]{1,4}[a-z]{2,})*[A-Z]{0,4}|[A-Z]+", x) for x in re.split(r"[+/_=-]+", s) if x)
                if not covered[a] and len(s) >= 20 and not harmless(s) and not plain:
                    kinds = set(s)
                    least = 3.0 if kinds <= set("0123456789abcdefABCDEF") else 3.5 if not kinds & set("abcdefghijklmnopqrstuvwxyz+/_=-") else 3.7 if not kinds & set("+/_=-") else 3.8
                    high = bytearray(len(s))
                    for w in range(len(s) - 19):
                        if -sum(n / 20 * math.log2(n / 20) for n in Counter(s[w : w + 20]).values()) >= least - 1e-9:
                            high[w : w + 20] = b"\x01" * 20
                    found += [(a + m.start(), 3, a + m.end()) for m in re.finditer(b"\x01+", bytes(high))]
                a = b
        i = max(j, i + 1)
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{b}" for a, k, b in sorted(found))


def redact(text):
    out, at = [], 0
    for span in filter(None, secret_spans(text).split(",")):
        _, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], "[SECRET]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def chats(rows):
    """rows: (conv_id, turn, role, text); what the query tells of each conversation."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        marks = {"system": 11, "user": 13, "assistant": 7}  # characters of both marks of a turn
        chars = sum(marks[r] + len(t) + sum(t.count(x) for x in "\\[<") for _, r, t in turns)
        out.append((c, len(turns), sha(said), len(loss), sha(loss), chars))
    return out


def url_filter(pages, rules):
    """{page_id: (host, path, rule, verdict, doubt)}; doubt: whether the verdict is near the threshold."""
    parsed = {}
    for p, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = lower(re.split("[/?#]", rest)[0]) if rest is not None else ""
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0] if rest is not None else ""
        fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=lambda r: (len(r), r)) if fits else None
        parsed[p] = host, path, rule, html or ""
    verdicts = dict(rules)
    seed = defaultdict(lambda: [0.0, 0.0, 0.0])
    weight = Counter()
    for host, _, rule, html in parsed.values():
        if host:
            seed[host][2] += 1
            if rule:
                seed[host][verdicts[rule] == "block"] += 1
            for there in {lower(x) for x in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html)}:
                if there != host:
                    weight[host, there] += 1
    ties = set()
    for host in seed:
        labels = host.split(".")
        for i in range(len(labels) - 2):
            a, b = ".".join(labels[i:]), ".".join(labels[i + 1 :])
            ties |= {(a, b), (b, a)}
    for e in ties:
        weight[e] += 1
    hosts = {*seed, *(x for e in weight for x in e)}
    out, into = Counter(), Counter()
    for (a, b), w in weight.items():
        out[a] += w
        into[b] += w
    start = {h: list(seed[h]) if h in seed else [0.0] * 3 for h in hosts}
    now = start
    for _ in range(150):
        new = {h: [0.15 * x for x in start[h]] for h in hosts}
        for h in hosts:
            if not out[h]:
                new[h][0] += 0.85 * now[h][0]
            if not into[h]:
                new[h][1] += 0.85 * now[h][1]
                new[h][2] += 0.85 * now[h][2]
        for (a, b), w in weight.items():
            new[b][0] += 0.85 * now[a][0] * w / out[a]
            for k in (1, 2):
                new[a][k] += 0.85 * now[b][k] * w / into[b]
        now = new
    told = {}
    for p, (host, path, rule, _) in parsed.items():
        t, d, u = now.get(host, (0, 0, 0))
        trust, distrust = (t / u, d / u) if u else (0, 0)
        doubt = rule is None and (abs(distrust - 0.5) < 0.03 or (distrust > 0.4 and abs(distrust - trust) < 0.03))
        told[p] = host, path, rule, verdicts[rule] if rule else "block" if distrust > 0.5 and distrust > trust else "allow", doubt
    return told


def vector_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label)."""
    kept = sorted((i, v, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for r in kept:
                held[near(p, cut(r[2], p))[1]].append(cut(r[2], p))
            new.append([[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[p])])
        books = new
    digest = sha(",".join(str(v) for book in books for e in book for v in e))
    out, labels = [], Counter()
    for i, _, v, label in kept:
        found = [near(p, cut(v, p)) for p in range(parts)]
        error = sum(f for f, _ in found)
        labels[label] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    return [(i, code, error, labels[label], digest) for i, code, error, label in out]


def trie(rows, period=5, most=9):
    """rows: (conv_id, turn, role, text), turns distinct within a conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole = own.get(c - c % period, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    told = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(told[k][0] for k in kids[node]) or 1
        saved = sum(told[k][1] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        told[node] = leaves, saved
    least = {n: min(c for c, _ in m) for n, m in members.items()}
    ends = {n: sha(",".join(str(c) for c, length in sorted(m) if length == len(n))) for n, m in members.items()}
    return [(least[n], len(n), least[n[:-1]] if n else None, len(m), len(kids[n]), *told[n], ends[n]) for n, m in members.items()]
