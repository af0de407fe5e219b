"""License scan by ordered signature rules.

Texts are scanned as UTF-8 with A-Z lower-cased; words are runs of ASCII
letters, digits and bytes beyond ASCII, and a blank in a signature stands for
any run of other bytes. Each rule is a regex with a label, a priority, a
weight and the keywords it needs: the keywords are looked for first, by plain
substring search and once per text for all rules, and only the rules whose
keywords are all there run. The signatures are written one by one: sentences
of licenses and notices (``license_signatures``), and names of licenses, which
also run inside a few sentence forms (tag, grant, title, link).

Detections overlap ("MIT License" inside "under the MIT License"). One is
suppressed when its interval is contained in that of a detection of higher
priority, or of the same priority and a longer or earlier interval. Of three
base signatures all places are counted besides, and their labels always stay.

The scan is a map over documents: nothing is shuffled, and a task holds one
Arrow batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, utf8
from .license_signatures import SIGNATURES

#: phrase, label
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_WORD = rb"0-9a-z\x80-\xff"
_GAP = rb"[^" + _WORD + rb"]+"
_IS_WORD = np.zeros(256, dtype=np.uint8)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1

# label | name signatures, parted by " / " | identifier in tags | keyword. In a
# signature a blank is any gap between words; the rest is regex.
NAMES = """
mit | (?:mit|expat) licen[sc]e / mit x11 licen[sc]e | mit(?:-0|-cmu)? | mit|expat
mit | permission is hereby granted free of charge to any person obtaining a copy | x11 | granted
apache-2 | apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)? / apache 2 0 | apache-2[.]0 | apache
apache-1.1 | apache(?: software)? licen[sc]e(?: version)? v?1 1 | apache-1[.]1 | apache
apache-1.0 | apache(?: software)? licen[sc]e(?: version)? v?1 0 | apache-1[.]0 | apache
gpl-2 | gnu general public licen[sc]e(?: version)? v?2 / gpl ?v?2(?: 0)? | gpl-2[.]0(?:-only|-or-later|[+])? | gpl|general
gpl-3 | gnu general public licen[sc]e(?: version)? v?3 / gpl ?v?3(?: 0)? | gpl-3[.]0(?:-only|-or-later|[+])? | gpl|general
gpl-2 | general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2 | gnu-gpl-2 | general
gpl-3 | general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3 | gnu-gpl-3 | general
gpl | gnu general public licen[sc]e | gpl | gnu
lgpl-2.1 | gnu (?:lesser|library) general public licen[sc]e(?: version)? v?2(?: 1)? / lgpl ?v?2(?: 1)? | lgpl-2[.][01](?:-only|-or-later|[+])? | lgpl|lesser|library
lgpl-3 | gnu lesser general public licen[sc]e(?: version)? v?3 / lgpl ?v?3 | lgpl-3[.]0(?:-only|-or-later|[+])? | lgpl|lesser|library
lgpl | gnu (?:lesser|library) general public licen[sc]e | lgpl | lesser|library
agpl-3 | gnu affero general public licen[sc]e(?: version)?(?: v?3)? / agpl ?v?3 | agpl-3[.]0(?:-only|-or-later|[+])? | a(?:gpl|ffero)
gfdl | gnu free documentation licen[sc]e | gfdl-1[.][123](?:-only|-or-later)? | documentation
bsd-2 | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)? | bsd-2-clause | bsd
bsd-3 | (?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)? | bsd-3-clause(?:-clear)? | bsd
bsd-4 | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)? | bsd-4-clause | bsd
bsd-0 | (?:zero clause bsd|bsd zero clause)(?: licen[sc]e)? | 0bsd | bsd
bsd | bsd(?: style)? licen[sc]e | bsd | bsd
bsd | redistribution and use in source and binary forms with or without modification | bsd-source-code | redistribution
isc | isc licen[sc]e | isc | isc
isc | permission to use copy modify and or distribute this software for any purpose | isc-veillard | permission
mpl-1.1 | mozilla public licen[sc]e(?: version)? v?1 1 / mpl 1 1 | mpl-1[.][01] | m(?:ozilla|pl)
mpl-2 | mozilla public licen[sc]e(?: version)?(?: v?2(?: 0)?)? / mpl 2(?: 0)? | mpl-2[.]0 | m(?:ozilla|pl)
epl-1 | eclipse public licen[sc]e(?: version)? v?1(?: 0)? | epl-1[.]0 | eclipse
epl-2 | eclipse public licen[sc]e(?: version)?(?: v?2(?: 0)?)? | epl-2[.]0 | eclipse
cddl | common development and distribution licen[sc]e | cddl-1[.][01] | development
cpl | common public licen[sc]e | cpl-1[.]0 | common
ibm-pl | ibm public licen[sc]e | ipl-1[.]0 | ibm
eupl | european union public licen[sc]e / eupl v?1 [012] | eupl-1[.][012] | eu(?:ropean|pl)
artistic-1 | artistic licen[sc]e(?: version)? v?1(?: 0)? | artistic-1[.]0(?:-perl|-cl8)? | artistic
artistic-2 | artistic licen[sc]e(?: version)?(?: v?2(?: 0)?)? | artistic-2[.]0 | artistic
zlib | zlib(?: libpng)? licen[sc]e | zlib(?:-acknowledgement)? | zlib
boost | boost software licen[sc]e(?: version)?(?: 1 0)? | bsl-1[.]0 | boost
unlicense | this is free and unencumbered software released into the public domain / the unlicense | unlicense | un(?:encumbered|license)
wtfpl | do what the fuck you want to public licen[sc]e / wtfpl | wtfpl | wtfpl|fuck
python | python software foundation licen[sc]e / psf licen[sc]e | psf-2[.]0 | p(?:ython|sf)
php | php licen[sc]e | php-3[.]0?1? | php
ruby | ruby licen[sc]e | ruby | ruby
postgresql | postgresql licen[sc]e | postgresql | postgresql
openssl | openssl licen[sc]e | openssl | openssl
ofl-1.1 | (?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])? | ofl-1[.][01](?:-rfn|-no-rfn)? | font
ms-pl | microsoft public licen[sc]e | ms-pl | microsoft
ms-rl | microsoft reciprocal licen[sc]e | ms-rl | microsoft
afl | academic free licen[sc]e | afl-[123][.][01] | academic
osl | open software licen[sc]e | osl-[123][.][01] | open
ncsa | university of illinois ncsa open source licen[sc]e / ncsa licen[sc]e | ncsa | ncsa
upl | universal permissive licen[sc]e | upl-1[.]0 | permissive
vim | vim licen[sc]e | vim | vim
w3c | w3c software(?: notice and)? licen[sc]e | w3c(?:-19980720|-20150513)? | w3c
sspl | server side public licen[sc]e | sspl-1[.]0 | server
busl | business source licen[sc]e | busl-1[.]1 | business
elastic | elastic licen[sc]e(?: 2(?: 0)?)? | elastic-2[.]0 | elastic
odbl | open (?:data commons open )?database licen[sc]e / odbl | odbl-1[.]0 | od(?:bl|atabase)|database
odc-by | open data commons attribution licen[sc]e | odc-by-1[.]0 | commons
pddl | public domain dedication and licen[sc]e | pddl-1[.]0 | dedication
ogl-uk | open government licen[sc]e | ogl-uk-[123][.]0 | government
beerware | beer ?ware licen[sc]e | beerware | beer
jsl | the software shall be used for good not evil | json | evil
llama | llama [23](?: [0-9])? community licen[sc]e | llama[23]? | llama
openrail | (?:creativeml |bigscience )?open ?rail(?: [+]?[ms])? licen[sc]e / responsible ai licen[sc]e | (?:creativeml-)?openrail(?:-m)? | rail|responsible
cc0 | cc0(?: 1 0)?(?: universal)? / creative commons zero | cc0-1[.]0 | c(?:c0|ommons)
cc-pdm | public domain mark(?: 1 0)? | pdm-1[.]0 | mark
""".strip().splitlines()

# Creative Commons: code words, name words
CC = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
      ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"),
      ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# label | signature | keyword, for notices that name no license
NOTICES = """
all-rights-reserved | all rights reserved | reserved
public-domain | (?:is|are|in|into|to) the public domain | domain
proprietary | proprietary and confidential / unauthorized (?:copying|use|distribution) | proprietary|unauthorized
non-commercial | for (?:non ?commercial|personal) use only / not for commercial use | commercial|personal
copyright | copyright (?:c |© )?(?:19|20)[0-9][0-9] | copyright
copyright | © (?:19|20)[0-9][0-9] | ©
no-redistribution | (?:may not be|no) (?:reproduced|redistributed|redistribution) | re(?:produced|distribut)
by-permission | (?:used|reproduced|reprinted) (?:by|with) permission | permission
""".strip().splitlines()


#: How sure a detection of a priority is.
WEIGHTS = {6: 1.0, 5: 0.95, 4: 0.9, 3: 0.8, 2: 0.6, 1: 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    needs: tuple[str, ...]      # keywords, "|" between alternatives
    priority: int
    weight: float


def _needs(spec: str) -> str:
    """Keyword alternatives of a table cell: ``x(?:a|b)`` is xa|xb."""
    return re.sub(r"^(\w+)\(\?:(\w+)\|(\w+)\)", r"\1\2|\1\3", spec.strip())


def rules() -> list[Rule]:
    """All signature rules, the more specific ones first."""
    out = []
    for line in NAMES:
        label, names, tag, key = (x.strip() for x in line.split(" | "))
        need = _needs(key)
        out.append(Rule(label, f"spdx license identifier {tag.replace('-', ' ').replace('[.]', ' ')}", ("spdx",), 6, 1.0))
        for name in names.split(" / "):
            out += [
                Rule(label, f"(?:licen[sc]ed|released|distributed|available|provided|published)(?: (?:to you|freely))? "
                            f"under (?:the )?(?:terms of )?(?:the )?{name}", (need, "under"), 5, 0.95),
                Rule(label, f"under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", (need, "under"), 4, 0.9),
                Rule(label, f"licen[sc]e (?:is )?(?:the )?{name}", (need, "licen"), 3, 0.8),
                Rule(label, name, (need,), 2, 0.6),
            ]
    for code, name in CC:
        label = "cc-" + code.replace(" ", "-")
        for v in CC_VERSIONS:
            tag = f"{label}-{v.replace(' ', '.')}"
            out += [Rule(tag, f"spdx license identifier cc {code} {v}", ("spdx",), 6, 1.0),
                    Rule(tag, f"under (?:a |the )?(?:terms of )?(?:a |the )?(?:cc {code}|creative commons {name})(?: licen[sc]e)? {v}",
                         ("cc|creative", "under"), 5, 0.95),
                    Rule(tag, f"creativecommons org licenses {code} {v}", ("creativecommons",), 5, 0.95),
                    Rule(tag, f"cc {code} {v}", ("cc", v.split()[0]), 3, 0.85),
                    Rule(tag, f"creative commons {name}(?: licen[sc]e)?(?: version)? v?{v}", ("creative",), 3, 0.85)]
        out += [Rule(label, f"cc {code}(?: licen[sc]e)?", ("cc", code.split()[-1]), 2, 0.6),
                Rule(label, f"creative commons {name}(?: licen[sc]e)?", ("creative",), 2, 0.6)]
    for line in SIGNATURES:
        label, priority, pattern, key = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, f"(?:{pattern})", (key,), int(priority), WEIGHTS[int(priority)]))
    for line in NOTICES:
        label, names, key = (x.strip() for x in line.split(" | "))
        out += [Rule(label, name, (_needs(key),), 1, 0.4) for name in names.split(" / ")]
    return out


def _regex(pattern: str) -> re.Pattern:
    """Compile a signature over lower-cased UTF-8; word ends are checked after it."""
    body = pattern.encode("utf-8").replace(b" ?", b"\0").replace(b" ", _GAP)
    return re.compile(body.replace(b"\0", b"(?:" + _GAP + b")?") + b"(?![" + _WORD + b"])")


class Scanner:
    def __init__(self, rule_list: list[Rule] | None = None):
        self.rules = rules() if rule_list is None else rule_list
        self.keys = sorted({k for r in self.rules for need in r.needs for k in need.split("|")})
        self.key_bytes = [k.encode("utf-8") for k in self.keys]
        at = {k: i for i, k in enumerate(self.keys)}
        self.needs = [[[at[k] for k in need.split("|")] for need in r.needs] for r in self.rules]
        by_key: dict[int, list[int]] = {}
        for n, needs in enumerate(self.needs):
            for k in needs[0]:
                by_key.setdefault(k, []).append(n)
        self.by_key = by_key
        self.compiled: dict[int, re.Pattern] = {}
        self.base = [(p.split()[0].encode(), [w.encode() for w in p.split()], _regex(p), label) for p, label in BASE]

    @staticmethod
    def _places(rx: re.Pattern, data: bytes):
        """Matches that begin at a word's begin."""
        at = 0
        while m := rx.search(data, at):
            s = m.start()
            if s and _IS_WORD[data[s - 1]] and _IS_WORD[data[s]]:
                at = s + 1
                continue
            yield s, m.end()
            at = m.end()

    def detections(self, data: bytes) -> list[tuple]:
        """``(start, end, rule number)`` of every rule whose keywords are present."""
        present = {i for i, k in enumerate(self.key_bytes) if k in data}
        if not present:
            return []
        runs = sorted({n for k in present for n in self.by_key.get(k, ())})
        out = []
        for n in runs:
            if all(any(k in present for k in alts) for alts in self.needs[n]):
                rx = self.compiled.get(n)
                if rx is None:
                    rx = self.compiled[n] = _regex(self.rules[n].pattern)
                out += [(s, e, n) for s, e in self._places(rx, data)]
        return out

    def resolve(self, found: list[tuple]) -> list[tuple]:
        """Detections that no other one of at least their priority contains."""
        kept: list[tuple] = []
        starts, ends = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for p in sorted({self.rules[n].priority for _, _, n in found}, reverse=True):
            same = sorted((s, -e, n) for s, e, n in found if self.rules[n].priority == p)
            far, fresh = -1, []
            for s, minus_end, n in same:
                e = -minus_end
                if e <= far:
                    continue
                far = e
                k = int(np.searchsorted(starts, s, side="right"))
                if k and ends[k - 1] >= e:
                    continue
                fresh.append((s, e, n))
            kept += fresh
            order = sorted((s, e) for s, e, _ in kept)
            starts = np.array([s for s, _ in order], dtype=np.int64)
            ends = np.maximum.accumulate(np.array([e for _, e in order], dtype=np.int64)) if order else ends
        return sorted(kept)

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
        data = text.lower()
        flags = _IS_WORD[np.frombuffer(data, dtype=np.uint8)]
        begins = flags.copy()
        begins[1:] &= 1 - flags[:-1]
        n_words = int(begins.sum())
        base, base_labels = [], set()
        for _, parts, rx, label in self.base:
            if all(w in data for w in parts):
                for s, _ in self._places(rx, data):
                    base.append(s)
                    base_labels.add(label)
        kept = self.resolve(self.detections(data))
        labels = base_labels | {self.rules[n].label for _, _, n in kept}
        score = max([0.9] * bool(base) + [self.rules[n].weight for _, _, n in kept], default=0.0)
        words = [int(begins[:s].sum(dtype=np.int64)) for s in ((min(base), max(base)) if base else ())]
        spans = [{"start": s, "end": e, "label": self.rules[n].label} for s, e, n in kept]
        return (n_words, len(base), words[0] if base else None, words[1] if base else None,
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans)


_WORKER: list[Scanner] = []


def scan_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``, with ``spans`` also the kept detections.

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest word index at which one starts
    (null without any); label lists are distinct, sorted and comma-joined, the
    empty string without any. ``score`` is the largest weight among the kept
    rules, zero without any. Spans are byte offsets in the UTF-8 text. A text of
    any length is scanned whole, with memory in proportion to it. A null text is empty, a null ``doc_id`` stays null, repeated rows are scanned
    alike, an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(frames):
        if not _WORKER:
            _WORKER.append(Scanner())
        for pdf in frames:
            made = pd.DataFrame([_WORKER[0].scan(b) for b in utf8(pdf["text"])], columns=names)
            for c in ("first_word", "last_word"):
                made[c] = made[c].astype("Int64")
            made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield made if spans else made.drop(columns="spans")

    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    return map_frames(rows, run, schema + ", spans array<struct<start: long, end: long, label: string>>" * spans)

