"""License scans: base phrases, and template markup compiled to token automata.

A template is a text of words with two kinds of markup: `[[ ... ]]` encloses an optional
region, `{{k}}` stands for a replaceable region of 0 to k words. Everything else is
mandatory and must match word for word. The bank holds public licences as whole texts and the
notices that are put into files; templates in SPDX markup are taken by `from_spdx`. Each
template is compiled into one non-deterministic token automaton; a text matches where the
automaton accepts a run of its words. Of all runs the one with the most of the
template's fixed words counts, and their share in the template (optional regions
included) grades the score.

Defined cases: null and empty texts have no words (score 0, empty labels); very long
texts are read whole; of ties the best share counts, and labels are sorted; repeated rows and
ids are judged alone; an empty table gives an empty result; only id and text are read, so
clashing extra columns do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import annotate, per_text

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licences and notices in this module's markup, as its words split.
_AS_IS_MIT = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the [[ authors or ]] copyright holders [[ or authors ]] be liable for any
claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the
use or other dealings in the software"""
_AS_IS_BSD = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct
indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of
use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD_TWO = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and
or other materials provided with the distribution"""
_GNU_WARRANTY = """this {{3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu {{2}} general public license for more details"""
TEMPLATES = {
    "text:mit": f"""[[ the ]] [[ mit license ]] [[ mit ]] [[ copyright {{{{12}}}} ]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files {{{{3}}}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software
{_AS_IS_MIT}""",
    "text:bsd-2-clause": f"[[ copyright {{{{12}}}} ]] [[ all rights reserved ]] {_BSD_TWO} {_AS_IS_BSD}",
    "text:bsd-3-clause": f"""[[ copyright {{{{12}}}} ]] [[ all rights reserved ]] {_BSD_TWO} [[ 3 ]] neither the name of {{{{12}}}} nor the names of {{{{3}}}} contributors may be used to endorse
or promote products derived from this software without specific prior written permission {_AS_IS_BSD}""",
    "text:isc": """[[ isc license ]] [[ copyright {{12}} ]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and {{6}} disclaims all warranties with regard to
this software including all implied warranties of merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
arising out of or in connection with the use or performance of this software""",
    "text:zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
subject to the following restrictions [[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use
this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[ 2 ]] altered source versions must be plainly
marked as such and must not be misrepresented as being the original software [[ 3 ]] this notice may not be removed or altered from any source distribution""",
    "text:unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "text:boost": """[[ boost software license version 1 0 ]] {{6}} permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software
and to permit third parties to whom the software is furnished to do so all subject to the following""",
    "notice:apache": """licensed under the apache license [[ version {{2}} ]] [[ the license you may not use this file except in compliance with the license you may obtain a copy of the license at
[[ http ]] [[ https ]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license ]]""",
    "notice:gpl": f"""[[ this {{{{3}}}} is free software ]] [[ you can redistribute it and or modify it ]] [[ it under ]] [[ licensed ]] under the [[ terms of the ]] [[ terms of ]] gnu [[ lesser ]] [[ affero ]] [[ library ]] general public license
[[ as published by the free software foundation ]] [[ either ]] version {{{{2}}}} [[ of the license ]] [[ or at your option any later version ]] [[ {_GNU_WARRANTY} ]]""",
    "notice:mpl": """this source code form is subject to the terms of the mozilla public license v 2 0 [[ if a copy of the mpl was not distributed with this file you can obtain one at
[[ http ]] [[ https ]] [[ www ]] mozilla org mpl 2 0 ]]""",
    "notice:cc": """licensed under [[ a ]] [[ the ]] [[ creative commons ]] cc by [[ nc ]] [[ nd ]] [[ sa ]] {{2}}""",
    "notice:cc-name": """licensed under [[ a ]] [[ the ]] creative commons attribution [[ non commercial ]] [[ noncommercial ]] [[ noderivatives ]] [[ no derivatives ]] [[ sharealike ]] [[ share alike ]] {{2}}
[[ international ]] [[ unported ]] [[ generic ]] license""",
    "notice:cc0": """to the extent possible under law {{12}} waived all copyright and related or neighboring rights to {{12}}""",
    "notice:mit": """[[ is ]] [[ are ]] [[ released ]] [[ licensed ]] [[ distributed ]] [[ available ]] under the [[ terms of the ]] mit license [[ see the license file for details ]]""",
    "notice:bsd": """under [[ the ]] [[ terms of the ]] [[ a ]] [[ 2 clause ]] [[ 3 clause ]] [[ simplified ]] [[ modified ]] bsd [[ style ]] license""",
    "grant:mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{4}} to deal in {{3}} without restriction""",
    "grant:bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met""",
    "disclaimer": """provided [[ on an ]] as is [[ basis ]] without warranty of any kind [[ either ]] [[ express or implied ]] [[ expressed or implied ]]""",
    "rights": "all rights reserved",
}

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the contract as UTF-8: ASCII letters lower-cased, letters, digits and all non-ASCII kept."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """A template as a token automaton: states are positions, None is a skip, b"" any one word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        for token in template.split():
            here = len(self.edges) - 1
            if token == "[[":
                opened.append(here)
            elif token == "]]":
                self.skips[opened.pop()].append(here)
            elif m := re.fullmatch(r"\{\{(\d+)\}\}", token):
                end = here + int(m[1])
                for k in range(here, end):
                    self._add(k, b"")
                    self.skips[k].append(end)
            else:
                self._add(here, token.encode())
                if not opened:
                    self.mandatory.append(token.encode())
        self.final = len(self.edges) - 1
        self.anchor = max(self.mandatory, key=len)
        self.literals = sum(1 for row in self.edges for w, _ in row if w)
        self.first = self._starts()
        # The anchor's distance from the start, for windows around its occurrences.
        self.reach = self.final + 1

    def _add(self, state: int, word: bytes) -> None:
        self.edges[state].append((word, state + 1))
        self.edges.append([])
        self.skips.append([])

    def _closure(self, states: dict[int, int]) -> dict[int, int]:
        """States reached without a word, each with the most fixed words read on the way to it."""
        out = dict(states)
        todo = sorted(states)
        while todo:
            s = todo.pop()
            for t in self.skips[s]:
                if out.get(t, -1) < out[s]:
                    out[t] = out[s]
                    todo.append(t)
        return out

    def _starts(self) -> set[bytes]:
        return {w for s in self._closure({0: 0}) for w, _ in self.edges[s]}

    def accepts_at(self, words: list[bytes], start: int) -> tuple[int, int]:
        """End of the longest accepted run from start, and its fixed words; (-1, 0) where none is."""
        states, best, i = self._closure({0: 0}), (-1, 0), start
        while states and i < len(words):
            moved: dict[int, int] = {}
            for s, n in states.items():
                for w, t in self.edges[s]:
                    if w == words[i]:
                        moved[t] = max(moved.get(t, -1), n + 1)
                    elif w == b"":
                        moved[t] = max(moved.get(t, -1), n)
            states = self._closure(moved)
            i += 1
            if self.final in states:
                best = (i, max(states[self.final], best[1]))
        return best

    def share(self, words: list[bytes], positions: list[int]) -> float:
        """Largest share of the fixed words in an accepted run that holds one of the anchor's positions; 0 where none is."""
        tried: set[int] = set()
        most = 0
        for p in positions:
            for s in range(max(0, p - self.reach), p + 1):
                if s not in tried and (words[s] in self.first or b"" in self.first):
                    tried.add(s)
                    end, n = self.accepts_at(words, s)
                    if end > p:
                        most = max(most, n)
        return most / self.literals

    def found(self, words: list[bytes], positions: list[int]) -> bool:
        return self.share(words, positions) > 0


def from_spdx(template: str) -> str:
    """A template in SPDX markup, in this module's: optional regions, and variables as replaceable ones.

    A variable's `match` of the form .{a,b} allows about b / 4 words, any other 20.
    """
    out = []
    for part in re.split(r"(<<.*?>>)", template, flags=re.S):
        if part.startswith("<<beginOptional"):
            out.append("[[")
        elif part.startswith("<<endOptional"):
            out.append("]]")
        elif part.startswith("<<var"):
            m = re.search(r"\.\{\d+,(\d+)\}", part)
            out.append("{{%d}}" % (max(1, min(500, int(m[1]) // 4)) if m else 20))
        else:
            out += [w.decode("utf-8", "surrogatepass") for w in words_of(part)]
    return " ".join(out)


def scanner(phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None):
    """A function from texts to the scan's columns."""
    base = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]
    marks = [(name, Automaton(t)) for name, t in (templates or TEMPLATES).items()]
    needed = [sorted({b" " + w + b" " for w in a.mandatory}, key=len, reverse=True) for _, a in marks]
    wanted = {p[0] for p, _ in base} | {a.anchor for _, a in marks}

    def scan(texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in texts:
            words = words_of(text)
            joined = b" " + b" ".join(words) + b" "
            starts: list[int] = []
            labels: set[str] = set()
            more: set[str] = set()
            where: dict[bytes, list[int]] | None = None
            best = 0.0

            def at(w: bytes, words=words) -> list[int]:
                nonlocal where
                if where is None:
                    where = {}
                    for i, x in enumerate(words):
                        if x in wanted:
                            where.setdefault(x, []).append(i)
                return where.get(w, [])

            for phrase, label in base:
                if b" " + b" ".join(phrase) + b" " in joined:
                    hits = [i for i in at(phrase[0]) if words[i : i + len(phrase)] == phrase]
                    starts += hits
                    labels.add(label)
            for (name, a), need in zip(marks, needed, strict=True):
                if all(w in joined for w in need):
                    share = a.share(words, at(a.anchor))
                    if share:
                        more.add(name)
                        best = max(best, share)
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts) if starts else None)
            out["last_word"].append(max(starts) if starts else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | more)))
            out["score"].append(0.5 + 0.5 * best if more else 0.25 if labels else 0.0)
        for k in ("first_word", "last_word"):
            out[k] = _nullable(out[k])
        return out

    return scan


def _nullable(values: list):
    import pandas as pd

    return pd.array(values, dtype="Int64")


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict | None = None, templates: dict | None = None) -> DataFrame:
    """One row per row of docs: id, word count, base hits, labels and a score.

    score is 0.5 to 1 where a template accepts, by the share of its fixed words that the text
    has, 0.25 where only a phrase occurs, else 0.
    """
    return annotate(docs, per_text(lambda: scanner(phrases, templates), SCHEMA), id_col, text_col)
