"""Plain single-machine versions that the operators are compared with."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from tokenizers import Tokenizer

from panelkit.llm.bpe import public_path


def bpe_digests(text: str | None) -> tuple[int, str, str]:
    t = Tokenizer.from_file(public_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    out = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def simhash(text: str | None, k: int = 3) -> int:
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_rows(docs: list[tuple]) -> dict:
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    fp = {i: simhash(t) for i, t in docs}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 3]
    comp = components(ids, links)
    return {i: (f"{fp[i]:016x}", comp[i]) for i in ids}


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = set(shingles(a, k)), set(shingles(b, k))
    return len(x & y) / len(x | y) if x | y else 1.0


def usable(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def nearest(rows: list[tuple], every: int = 20, k: int = 20) -> dict:
    rows = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (m * v).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vector_links(rows: list[tuple], cosine: float = 0.9) -> dict:
    good = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    ids = [i for i, _ in good]
    m = np.array([v / np.sqrt((v * v).sum()) for _, v in good])
    hit = m @ m.T >= cosine
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(np.triu(hit))
    comp = components([i for i, _ in rows], [(ids[x], ids[y]) for x, y in zip(a, b)])
    n = dict(zip(ids, hit.sum(1).tolist()))
    return {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def planted_tail(doc_id, text: str | None) -> list[bytes]:
    """The words of a document after the contract's rewriting, word by word."""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by looking at every lag at every word."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def run_row(w: list[bytes]) -> tuple:
    runs = periodic_runs(w)
    kept = [True] * len(w)
    for s, n, q in runs:
        for i in range(s + q, s + n):
            kept[i] = False
    sha = lambda b: hashlib.sha256(b).hexdigest()
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for x, k in zip(w, kept) if k)))


def divergences(docs: list[tuple], least: int = 3, ranks: int = 200) -> set:
    """Rows of the source audit from (text, lang, source), term by term."""
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for t, _, _ in docs]
    df, n = Counter(), Counter()
    for (_, lang, source), ts in zip(docs, terms):
        df.update((lang, t) for t in set(ts))
        n.update((lang, source, t) for t in ts)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for (x, t), k in df.items() if x == lang and k >= least]
        groups = {d[2] for d in docs if d[1] == lang}
        count = {s: {t: n[lang, s, t] for t in kept} for s in groups}
        whole = {t: sum(count[s][t] for s in groups) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // q
        p, q = {s: shares(count[s]) for s in groups}, shares(whole)
        for s in groups:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups - {s})
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:ranks]
            out |= {(lang, s, part, item, -v, k) for part, rows in (("pair", pair), ("term", term)) for k, (v, _, item) in enumerate(rows, 1)}
    return out


def url_verdict(url: str | None, rules: list[tuple], default: str = "allow") -> tuple:
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


# ---- personal data, value by value
PII_ROUNDS = 8


def _mix(key, tweak, k, j, by) -> str:
    return hashlib.sha256("|".join(map(str, (key, tweak, k, j, by))).encode()).hexdigest()


def _low(c: str) -> int:
    return 48 if c.isdigit() else 97 if c.islower() else 65


def _size(c: str) -> int:
    return 10 if c.isdigit() else 26


def permuted(w: str, tweak: str, key: str) -> str:
    if not w:
        return ""
    if len(w) == 1:
        order = sorted(range(_size(w)), key=lambda x: _mix(key, tweak, "one", _low(w), x))
        return chr(_low(w) + order[ord(w) - _low(w)])
    half = [w[: len(w) // 2], w[len(w) // 2 :]]
    for k in range(PII_ROUNDS):
        part, by = half[k % 2], half[1 - k % 2]
        hs = "".join(_mix(key, tweak, k, j, by) for j in range((len(part) - 1) // 16 + 1))
        half[k % 2] = "".join(chr(_low(c) + (ord(c) - _low(c) + int(hs[4 * i : 4 * i + 4], 16)) % _size(c)) for i, c in enumerate(part))
    return "".join(half)


def refilled(form: str, new: str) -> str:
    it = iter(new)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in form)


def luhn_digit(d: str) -> str:
    t = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
    return str(-t % 10)


def _numbers(left: int, right: int, a: int, b: int, tweak: str, key: str) -> tuple[int, int]:
    f = lambda k, v: int(hashlib.sha256(f"{key}|{tweak}|{k}|{v}".encode()).hexdigest()[:15], 16)
    for k in range(PII_ROUNDS):
        if k % 2 == 0:
            left = (left + f(k, right) % a) % a
        else:
            right = (right + f(k, left) % b) % b
    return left, right


def pseudonym(kind: str, m: str, key: str) -> str:
    """The pseudonym of one match; bare cards only, no chains of groups."""
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, place = m[: m.index("@")], m[m.index("@") :]
        return refilled(local, permuted(re.sub("[^A-Za-z0-9]", "", local), place.lower(), key)) + place
    if kind == "phone":
        two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
        c = "" if m[0] != "+" else d[0] if d[0] in "17" else d[:2] if d[:2] in two else d[:3]
        return refilled(m, c + permuted(d[len(c) :], (c or "1") + "p", key)) if 7 <= len(d) <= 15 else m
    if kind == "ssn":
        a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (1 <= a <= 899 and a != 666 and g and s):
            return m
        x, y = _numbers(a - 2 if a > 666 else a - 1, (g - 1) * 9999 + s - 1, 898, 989901, "ssn", key)
        return f"{x + 2 if x >= 665 else x + 1:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if kind == "address":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        x, y = _numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "date":
        p = [int(x) for x in re.split("[-/.]", m)]
        order = "ymd" if "-" in m else "dmy" if "." in m or p[0] > 12 else "mdy"
        try:
            day = dt.date(*(p[order.index(x)] for x in "ymd"))
        except ValueError:
            return m
        first = dt.date(1900, 1, 1)
        if not first <= day <= dt.date(2099, 12, 31):
            return m
        n = (day - first).days
        x, y = _numbers(n // 319, n % 319, 229, 319, "date", key)
        new = first + dt.timedelta(days=x * 319 + y)
        short = bool(re.search("(?<![0-9])[0-9](?![0-9])", m))
        shown = {"y": f"{new.year:04d}", "m": f"{new.month:0{1 if short else 2}d}", "d": f"{new.day:0{1 if short else 2}d}"}
        return re.search("[-/.]", m)[0].join(shown[x] for x in order)
    if kind == "iban":
        v = m.replace(" ", "")
        mod = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if mod(v[4:] + v[:4]) != 1:
            return m
        p = permuted(v[4:], v[:2] + "b", key)
        return refilled(m, v[:2] + f"{98 - mod(p + v[:2] + '00'):02d}" + p)
    if len(d) < 13 or len(d) > 19 or luhn_digit(d[:-1]) != d[-1]:
        return m
    p = d[0] + permuted(d[1:-1], d[0] + "c", key)
    return refilled(m, p + luhn_digit(p))


def pseudonymised(text: str | None, key: str = "public-test-key") -> str | None:
    """Finds with plainer patterns than the operator's, which agree on the test tables."""
    if text is None:
        return None
    kinds = [
        ("email", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("iban", r"(?<![A-Za-z0-9])DE[0-9]{20}(?![A-Za-z0-9])"),
        ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("date", r"(?<![0-9.-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9])"),
        ("address", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"), ("card", r"(?<![0-9A-Za-z.-])[0-9]{13,19}(?![A-Za-z0-9])|(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![A-Za-z0-9])"),
    ]
    every = "|".join(f"(?P<{k}>{p})" for k, p in kinds)
    return re.sub(every, lambda m: pseudonym(m.lastgroup, m[0], key), text)
