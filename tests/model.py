"""Plain-Python statement of the scan and fingerprint semantics, for cross-checks only."""

from __future__ import annotations

import hashlib
import re


def scan_page(rule, text, check=lambda raw: True):
    """(count, score, sample, contexts) of one rule on one page, or None."""
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    kept, terms_seen = [], set()
    for found in re.finditer(rule.pattern, text, flags):
        raw = found.group(0)
        if rule.validator and not check(raw):
            continue
        near = text[max(0, found.start() - rule.window) : found.end() + rule.window].lower()
        terms = [t for t in rule.terms if t.lower() in near]
        terms_seen.update(terms)
        if rule.required and not terms:
            continue
        score = rule.base_confidence + (rule.validator_weight if rule.validator else 0.0)
        score = min(1.0, score + (rule.boost if terms else 0.0))
        if score >= rule.threshold:
            kept.append((score, raw))
    if len(kept) < rule.min_count:
        return None
    best = max((s for s, _ in kept), default=0.0)
    sample = next((r for s, r in kept if s == best), "").strip()
    a, b = rule.sample_prefix, rule.sample_suffix
    masked = "*" * len(sample) if len(sample) <= a + b else sample[:a] + "*" * (len(sample) - a - b) + sample[len(sample) - b :]
    return len(kept), best, masked, sorted(terms_seen)[:5]


def fingerprint(text, k=5, w=4):
    words = re.findall(r"\w+", text.lower())
    if not words:
        return set()
    hashes = [
        int(hashlib.md5(" ".join(words[i : i + k]).encode()).hexdigest()[:15], 16)
        for i in range(max(len(words) - k, 0) + 1)
    ]
    return {min(hashes[i : i + w]) for i in range(max(len(hashes) - w, 0) + 1)}
