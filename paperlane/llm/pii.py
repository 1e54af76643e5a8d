"""Personal information in free text: found by labelers that vote, weighed by expectation-maximisation.

One pass over the text proposes spans of five types and lets three kinds of labelers vote on each: its form (regular
expressions), its context (words before and behind it) and gazetteers (given names and surnames).  The gazetteers are
learned: words that stand often enough where only names stand, in their first or in their second place.  They propose spans, too: two words
side by side in free text of which one is a known given name and the other a known surname.  A vote is 1 (is one), -1 (is none) or 0 (no opinion).

The counts of vote patterns per type are all that expectation-maximisation needs: it estimates each labeler's
reliability and the patterns' posteriors, which are the soft labels of a logistic classifier over votes, pairs of
votes and the span's form.  Patterns are bounded (three values per labeler), whatever the corpus.  The classifier
decides every span; :func:`redact` puts typed placeholders where spans are and keeps the rest as it is.

Text is read as it was meant: lines are joined within paragraphs, words hyphenated at a line end are whole, characters
are in plain form.  Every character keeps the line it came from, so that a span's line is the line it begins on.

Defined results: NULL, empty and blank texts have no spans; spans of one type never overlap; repeated rows are
treated alike; text of any length is read whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.llm.plainform import is_plain, plain, traced
from paperlane.sources import checkpoints

TYPES = ("email", "phone", "id_number", "address", "name")
#: Votes, in this order.
LABELERS = ("form", "before", "behind", "against", "given", "surname", "alone")
CANDIDATES = "row_id string, pii_type string, line_no int, line_end int, start int, stop int, shape string, words array<string>, votes array<int>"

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_HYPHEN = "-‐‑­¬–"
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ01589]+(?:[-'’][A-ZÀ-Þ][a-zß-ÿ]+)?|[A-ZÀ-ÖØ-Þ]{3,})"
_LATIN_NAME = rf"(?:[A-Z]\. ?)?{_CAP}(?:, ?{_CAP}| (?:[A-Z]\. ?)?{_CAP})?"
_HAN_NAME = r"[㐀-鿿々ぁ-ゖ]{1,4} ?[㐀-鿿々ぁ-ゖァ-ヶー]{1,4}"
# The words before (and behind) which a kind of item stands, in the four languages.
_NAME_CUES = "|".join((
    rf"(?:Attn|Attention|Contact(?: person)?|Ansprechpartner(?:in)?|Kontakt|Sachbearbeiter(?:in)?|Interlocuteur|Interlocutrice|Contact ?|À l[’']attention de|Signed|Name|Nom|Responsable|Destinataire|Empfänger|Bearbeiter)[.:]? ?:? ?(?:Mr\.?|Mrs\.?|Ms\.?|Herrn?|Frau|M\.|Mme)? ?(?P<a>{_LATIN_NAME})",
    rf"(?:[Cc]onfirmed|[Rr]eceived|[Ss]igned|[Cc]hecked|[Aa]pproved|[Cc]ollected|[Aa]ccepted) by (?:Mr\.?|Mrs\.?|Ms\.?)? ?(?P<b>{_LATIN_NAME})",
    rf"(?:ask for|speak to|care of|c/o|attention of) (?:Mr\.?|Mrs\.?|Ms\.?)? ?(?P<c>{_LATIN_NAME})",
    rf"\b(?:Dear|Cher|Chère|Liebe[rs]?|Geehrte[rs]?|z\. ?Hd\.(?: von)?|z\. ?H\.) (?:Mr\.?|Mrs\.?|Ms\.?|Herrn?|Frau|M\.|Mme)? ?(?P<k>{_LATIN_NAME})",
    rf"\b(?:Mr\.?|Mrs\.?|Ms\.|Herrn?|Frau|Mme|Mlle|Monsieur|Madame) (?P<d>{_LATIN_NAME})",
    rf"(?:wurde von|angenommen von|erhalten von|unterzeichnet von|Empfangen durch|geprüft von) (?:Herrn?|Frau)? ?(?P<e>{_LATIN_NAME})",
    rf"(?:reçue?s? par|[Ss]ignée?s? par|[Vv]isée?s? par|contrôlée?s? par|remise?s? à|S[’']adresser à|Demander|Reçu par|validée?s? par) (?:M\.|Mme)? ?(?P<f>{_LATIN_NAME})",
    rf"(?:担当(?:者)?|受領者?|立会(?:人)?|氏名|検収者|承認者|連絡者|宛名)[:： ] ?(?P<g>{_HAN_NAME})(?=[。)） \n、/,]|$)",
    rf"(?:検収は|受領は|確認は) ?(?P<h>{_HAN_NAME})(?=が)",
    rf"(?:営業|担当|経理|購買|窓口)の(?P<i>{_HAN_NAME})(?=まで|が|に|へ|より)",
    rf"(?:^|[\n。、(（, ])(?P<j>{_HAN_NAME}) ?(?=様|殿|さん|氏)",
))
NAMES = re.compile(_NAME_CUES)
_HAS_CJK = re.compile(f"[{_CJK}]")
#: Names that stand alone on a line, with an initial, or in figures of address.
ALONE = re.compile(rf"(?m)^(?P<l>(?:[A-Z]\. ?)?{_CAP}(?:, ?{_CAP}| (?:[A-Z]\. ?)?{_CAP}))[.,]?$|^(?P<m>[㐀-鿿々]{{2,3}} ?[㐀-鿿々]{{2,3}})。?$")
#: Two words of free text that gazetteers may know, and the votes of such a span before they do.  The next span may begin with the second.
FREE = re.compile(rf"(?<![\w.'’&-])(?=({_CAP},? {_CAP})(?![\w'’&-]))|(?<![㐀-鿿々ぁ-ゖァ-ヶー])(?=([㐀-鿿々]{{1,3}} [㐀-鿿々ぁ-ゖ]{{1,3}})(?![㐀-鿿々ァ-ヶー]))")
BY_LIST = (0, 0, 0, 0, 0, 0, 0)
EMAIL = re.compile(r"(?ai)<?(?<![\w.+-])[a-z0-9][\w.+-]{0,60} ?(?:@|\(at\)|\[at\]|\{at\}) ?[a-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[a-z0-9-]+){1,4}")
NUMBER = re.compile(r"(?a)(?<![\w.,¥$€#@-])(?:\+ ?\d{1,3}[ -]?|00\d{2}[ -])?\(?\d{1,6}(?:(?:[ ./-]|\)[ -]?| ?\()\d{1,8}){1,6}(?!\d|[,.-]\d)|(?<![\w.,¥$€#@-])\d{9,13}(?!\w|,\d)|(?<![A-Za-z0-9-])[A-Z]{1,2}\d{6,9}(?![A-Za-z0-9])")
_ADDRESSES = (
    r"(?:〒 ?)?(?:\d{3}-\d{4} ?)?[㐀-鿿]{1,4}[都道府県][㐀-鿿]{1,5}[市区町村郡][㐀-鿿ぁ-んァ-ヶ]{0,6}(?:\d{1,4}丁目\d{1,4}番?地?\d{0,4}号?|\d{1,5}番地?(?:の?\d+号?)?|\d{1,4}(?:-\d{1,4}){1,3})",
    r"\b\d{1,5}[a-z]?,? (?:[NSEW]\. )?(?:[A-Z][\w'’]+ ){1,3}(?:Road|Rd\.?|Street|Str?\.|Row|Lane|Ln\.?|Avenue|Ave\.?|Hill|Drive|Dr\.|Way|Court|Square|Place|Terrace|Close|Quay|Boulevard|Blvd\.?|Walk|Yard|Wharf|Crescent|Parade|Gate)(?![a-z])",
    r"\b[A-ZÄÖÜ][\wäöüß-]*(?:gasse|straße|strasse|str\.|weg|allee|platz|ufer|steig|markt|kai|chaussee|zeile|pfad)\.? \d{1,4} ?[a-z]?(?!\w)",
    r"\b(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Bei der|Vor dem) (?:[A-ZÄÖÜ][\wäöüß-]+ ){1,3}\d{1,4} ?[a-z]?(?=,? \d{5}\b|[.,]?(?:\n|$))",
    r"\b\d{1,4}(?: (?:bis|ter))?,? (?:rue|quai|avenue|allée|boulevard|place|chemin|impasse|route|cours|ruelle|passage|sentier|montée|square)\b[^,.;\n]{2,40}",
    r"\b(?:rue|quai|avenue|allée|boulevard|chemin|impasse) (?:d[eu]s?|de la|d[’'])? ?[^,.;\n\d]{2,30},? \d{1,4}(?: bis)?(?!\d)",
)
ADDRESSES = [re.compile(x) for x in _ADDRESSES]
_NOT_NAME = re.compile(r"(?i)\b(ltd|gmbh|sa|co|inc|works|industries|partners|logistics|components|supply|trading|fournitures|desk|store|team|office|group|bench|department|abteilung|service|magasin|invoice|note|order|quotation|receipt|report|statement|rechnung|lieferschein|angebot|bestellung|quittung|prüfbericht|facture|bon|devis|reçu|page|seite|total|confidential|vertraulich|confidentiel|lager|wareneingang|einkauf|buchhaltung|versand\w*|qualitäts\w*|equipe|équipe|the|die|der|das|les|le|la|un|une|ein|eine)\b|会社|商事|工業|課|部$|係|室|倉庫|センター?|書|登録|合計|品目")
#: What makes the name before it a firm's or a department's.
_FIRM = re.compile(r"(?: |-in |-)(?:Ltd|GmbH|SA\b|Co\b|Inc|Works|Industries|Partners|Logistics|Components|Supply|Trading|Fournitures|desk|store|team|office|group|bench)", re.IGNORECASE)
_CUES = {
    "phone": (r"(?i)t[eé][l1i]|phone|fax|mobil|reach|erreichb|chauffeur|driver|anruf|rufnummer|portable|joindre|appel|call|電話|電|携帯|携|連絡先|番号は", r"(?i)until|bis \d|avant|へご連絡|まで"),
    "id_number": (r"(?i)\b[il1]d\b|[i1l]dent|passe?p|ausweis|steuer|fiscal|sécurité|permis|licen[cs]e|personal|personnel|pièce|card|carte|個人|本人|免許|旅券|保険|マイナンバー", r"(?i)at the gate|です|vorgelegt|présent"),
    "address": (r"(?i)deliver|address|anschrift|adresse|go to|geht an|livrer|wohn|resid|住所|納品先|お届け先|〒|送付先", r"(?i)instead of|statt ins|et non|に変更|zz\d|\d{5} [A-Z]"),
}
_AGAINST = r"(?i)track|sendung|suivi|colis|paket|parcel|shipment|追跡|追|送り状|regist|handelsreg|hrb|\brc\b|登録|charge|\blot\b|lot n|ロット|ロ|batch|item|artikel|article|order|auftrag|commande|invoice|rechnung|facture|quote|reference|vorgang|dossier|注文|受付|書類|伝票|口座|konto|iban|@ ?$|pcs|単価|金額|total|betrag|montant|page|seite|p\. ?$"


_SHORT_END, _OPEN_END = re.compile(r"[.。:：\d]$"), re.compile(r"[a-z,] ?\d*$")


def _placed(text: str, lines: list[str] | None = None) -> tuple[str, list[int], list[int]]:
    """(text read as it was meant, line of each of its characters, place of each in its line's plain form; -1 for what joins lines)."""
    if lines is None:
        whole = is_plain(text)
        lines = [x if whole else plain(x) or "" for x in text.split("\n")]
    out: list[str] = []
    at: list[int] = []
    places: list[int] = []
    for n, line in enumerate(lines):
        stripped = line.strip()
        indent = len(line) - len(line.lstrip())
        out.append(stripped)
        at.extend([n + 1] * len(stripped))
        places.extend(range(indent, indent + len(stripped)))
        if n + 1 == len(lines):
            break
        follows = lines[n + 1].strip()
        if not stripped or not follows or stripped[0] in "|#" or follows[0] in "|#" or (len(stripped) < 30 and _SHORT_END.search(stripped) and not _OPEN_END.search(stripped)):
            gap = "\n"
        elif stripped[-1] in _HYPHEN and len(stripped) > 1 and stripped[-2].isalpha() and (follows[0].islower() or (follows[0] in "0159" and follows[1:2].islower())):
            out[-1] = stripped[:-1].rstrip(_HYPHEN)
            if lost := len(stripped) - len(out[-1]):
                del at[-lost:], places[-lost:]
            gap = ""
        elif _HAS_CJK.search(stripped[-6:]) and _HAS_CJK.search(follows[:12] + stripped[-12:]):
            gap = ""
        else:
            gap = " "
        out.append(gap)
        at.extend([n + 1] * len(gap))
        places.extend([-1] * len(gap))
    return "".join(out), at, places


def view(text: str, lines: list[str] | None = None) -> tuple[str, list[int]]:
    """(text read as it was meant, line of each of its characters); ``lines`` in plain form where they are known."""
    return _placed(text, lines)[:2]


def _shape(text: str) -> str:
    """A number's form as the classifier sees it: how it begins, its groups of digits (eight or more are one), what divides the first two."""
    lead = "9" if text[0].isdigit() and text[0] != "0" else "a" if text[0].isalpha() else text[0] if text[0] in "+(0" else "?"
    groups = re.findall(r"\d+", text)
    divider = re.search(r"\d([ ./()-])", text)
    return f"{lead}{min(len(groups), 8)}{divider.group(1) if divider else ''}"


_ID_FORM = re.compile(r"^(\d{4}([ -])\d{4}\2\d{4}|\d{12}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{7})$")
_PHONE_FORM = re.compile(r"^(\+ ?\d|00\d|\(?0\d|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$|\(\d{3}\) ?\d)")
_DATE = re.compile(r"^(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})\b")


def _number_end(text: str, start: int, stop: int) -> tuple[int, int]:
    """Where a number ends: groups behind it that make it none (a house number, say) are left out."""
    stop = start + len(text[start:stop].rstrip(" ./(-"))
    end = stop
    while end > start:
        number = text[start:end]
        if _ID_FORM.match(number) or (_PHONE_FORM.match(number) and 9 <= sum(map(str.isdigit, number)) <= 13):
            return start, end
        end = start + len(re.sub(r"[ ./()-]*\d+$", "", number).rstrip(" ./(-")) if re.search(r"[ ./()-]\d+$", number) else start
    return start, stop


def _vote(pattern: str, text: str) -> int:
    return 1 if re.search(pattern, text) else 0


def _name_words(name: str) -> list[str]:
    """The words of a name, as they are said: what stands behind a comma comes first."""
    words = [w for w in re.split(r"[ ,.]+", name) if len(w) > 1]
    return words[::-1] if "," in name and len(words) == 2 else words


def spans(text: str) -> list[tuple[str, int, int, int, int, str, list[str], list[int]]]:
    """(type, line, last line, start, stop, shape, words, votes) of each proposed span of a text, in its view."""
    joined, at = view(text)
    found: list[tuple[str, int, int, int, int, str, list[str], list[int]]] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(taken, (b, 0))  # the spans before it begin before b
        return k == 0 or taken[k - 1][1] <= a

    def put(kind: str, a: int, b: int, votes: list[int], words: list[str] | None = None) -> None:
        while b > a and joined[b - 1] in " \n":
            b -= 1
        found.append((kind, at[a], at[b - 1], a, b, _shape(joined[a:b]), words or [], votes))
        bisect.insort(taken, (a, b))

    if "@" in joined or "at)" in joined.lower() or "at]" in joined.lower():
        for m in EMAIL.finditer(joined):
            a = m.start() + (m.group()[0] == "<")
            put("email", a, m.end(), [1, _vote(r"(?i)mail|contact|copy to|連絡先|合わせ|kontakt|an ", joined[max(0, a - 24) : a]), 0, 0, 0, 0, 0])
    for m in (m for k, pattern in enumerate(ADDRESSES) if (k > 0 or _HAS_CJK.search(joined)) for m in pattern.finditer(joined)):
        a = m.start()
        if not free(a, m.end()):
            continue
        before, behind = joined[max(0, a - 28) : a], joined[m.end() : m.end() + 24]
        put("address", a, m.end(), [1, _vote(_CUES["address"][0], before), _vote(_CUES["address"][1], behind), 0, 0, 0, int(a == 0 or joined[a - 1] in "\n")])
    for m in NUMBER.finditer(joined):
        k = bisect.bisect_right(taken, (m.start(), len(joined)))
        a, b = _number_end(joined, m.start(), min(m.end(), taken[k][0]) if k < len(taken) else m.end())
        number = joined[a:b]
        digits = sum(c.isdigit() for c in number)
        if not 7 <= digits <= 14 or _DATE.match(number) or not free(a, b):
            continue
        before, behind = joined[max(0, a - 26) : a].rpartition("\n")[2], joined[b : b + 14]
        before = re.split(r"[。.] (?=[A-Z])|。", before)[-1] if not re.search(r"(?i)(te[l1]|no|nr)\. ?$", before) else before
        against = -1 if re.search(_AGAINST, before) else 0
        as_id, as_phone = bool(_ID_FORM.match(number)), bool(_PHONE_FORM.match(number)) and digits >= 9
        cue_id, cue_phone = _vote(_CUES["id_number"][0], before), _vote(_CUES["phone"][0], before)
        if as_id and (cue_id or not cue_phone):
            put("id_number", a, b, [1, cue_id, _vote(_CUES["id_number"][1], behind), 0 if cue_id else against, 0, 0, int(not before.strip())])
        elif as_phone or cue_phone:
            put("phone", a, b, [1 if as_phone else -1, cue_phone, _vote(_CUES["phone"][1], behind), 0 if cue_phone else against or -cue_id, 0, 0, int(not before.strip())])
    for m in NAMES.finditer(joined):
        kind = m.lastgroup
        a, b = m.span(kind)
        name = m.group(kind)
        words = _name_words(name)
        if words and free(a, b):
            against = -1 if _NOT_NAME.search(name) or _FIRM.match(joined, b) else 0
            put("name", a, b, [against, 1, 0, against, 0, 0, 0], words)
    for m in ALONE.finditer(joined):
        a, b = m.span(m.lastgroup)
        if free(a, b) and not _NOT_NAME.search(joined[a:b]):
            put("name", a, b, [-1, 0, 0, 0, 0, 0, 1], _name_words(joined[a:b]))
    for m in FREE.finditer(joined):
        a, b = m.span(m.lastindex)
        if free(a, b) and len(words := _name_words(joined[a:b])) == 2 and not _NOT_NAME.search(joined[a:b]) and not _FIRM.match(joined, b):
            found.append(("name", at[a], at[b - 1], a, b, "", words, list(BY_LIST)))  # takes no place until the lists know it
    return found


def candidates(texts: DataFrame, row_id: str, text: str) -> DataFrame:
    """The proposed spans of all texts with the votes of form and context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CANDIDATES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(i, *s) for i, t in zip(batch["row_id"], batch["text"], strict=True) for s in spans(t)], columns=names)

    picked = texts.filter(F.col(text).isNotNull()).select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"))
    return picked.mapInPandas(run, CANDIDATES)


#: What is known of labelers before any text is seen: the rates of votes -1, 0 and 1 on what is none, and on what is one.
PRIOR = np.array([[0.38, 0.5, 0.12], [0.02, 0.53, 0.45]])


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, trust: float = 0.3) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern from the counts of patterns: two classes, labelers independent within a class.

    ``trust`` is the weight of PRIOR against the spans seen; without it, a type of which nearly all spans are true would be
    split by how many votes they got.
    """
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    strength = trust * n.sum()
    rates = np.repeat(PRIOR[:, None, :], votes.shape[1], axis=1)  # class, labeler, vote
    prior = np.array([0.5, 0.5])
    post = np.zeros(len(n))
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.log(rates[:, np.arange(votes.shape[1]), votes + 1]).sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        weight = np.stack((1 - post, post)) * n
        prior = (weight.sum(1) + strength / 2) / (n.sum() + strength)
        for v in (-1, 0, 1):
            rates[:, :, v + 1] = ((weight @ (votes == v)) + strength * PRIOR[:, None, v + 1]) / (weight.sum(1)[:, None] + strength)
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def train(patterns: list[tuple[tuple[int, ...], str, int]], posterior: dict[tuple[int, ...], float], steps: int = 400) -> dict[tuple[tuple[int, ...], str], float]:
    """Logistic classifier over votes, pairs of votes and shapes, trained on the posteriors; its probability of each pattern and shape."""
    shapes = sorted({s for _, s, _ in patterns})
    place = {s: i for i, s in enumerate(shapes)}

    def features(votes: tuple[int, ...]) -> list[float]:
        hot = [float(v == x) for v in votes for x in (-1, 1)]
        return [1.0, *hot, *(a * b for i, a in enumerate(hot) for b in hot[i + 1 :])]

    x = np.array([features(v) for v, _, _ in patterns])
    which = np.array([place[s] for _, s, _ in patterns])
    n = np.array([c for _, _, c in patterns], dtype=float)
    y = np.array([posterior[v] for v, _, _ in patterns])
    w, u = np.zeros(x.shape[1]), np.zeros(len(shapes))
    weight = np.sqrt(n) / np.sqrt(n).sum()
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + u[which], -30, 30)))
        gap = weight * (p - y)
        rate = 8.0 / math.sqrt(1 + step / 40)
        w -= rate * (x.T @ gap + 1e-4 * w)
        u -= rate * (np.bincount(which, gap, len(shapes)) + 1e-3 * u)
    p = 1 / (1 + np.exp(-np.clip(x @ w + u[which], -30, 30)))
    return {(v, s): float(q) for (v, s, _), q in zip(patterns, p, strict=True)}


def _gazetteers(found: DataFrame, least: int) -> DataFrame:
    """(word, first, second): words that stand in the first or second place of ``least`` names or more; a name of one word counts for both."""
    named = found.filter("pii_type = 'name' and votes[1] = 1 and votes[3] = 0 and size(words) between 1 and 2")
    words = named.select(F.posexplode(F.transform("words", F.lower)).alias("place", "word"), (F.size("words") == 1).alias("alone"))
    counts = words.groupBy("word").agg(F.count_if(F.col("alone") | (F.col("place") == 0)).alias("first"), F.count_if(F.col("alone") | (F.col("place") == 1)).alias("second"))
    return counts.select("word", (F.col("first") >= least).alias("first"), (F.col("second") >= least).alias("second")).filter("first or second")


def decided(texts: DataFrame, row_id: str, text: str, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """The accepted spans of all texts; a word that ``least`` names have is in the gazetteers."""
    found = checkpoints.cut(candidates(texts, row_id, text))
    known = _gazetteers(found, least)
    words = found.filter("pii_type = 'name'").select("row_id", "start", "line_no", F.posexplode(F.transform("words", F.lower)).alias("place", "word"))
    hits = words.join(known, "word").groupBy("row_id", "start", "line_no").agg(
        F.max(F.when((F.col("place") == 0) & F.col("first"), 1).otherwise(0)).alias("w0"), F.max(F.when((F.col("place") > 0) & F.col("second"), 1).otherwise(0)).alias("w1"))
    voted = found.join(hits, ["row_id", "start", "line_no"], "left")
    given, surname = F.coalesce("w0", F.lit(0)), F.coalesce("w1", F.lit(0))
    votes = F.concat(F.slice("votes", 1, 4), F.array(given, surname), F.slice("votes", 7, 1))
    by_list = (F.col("pii_type") == "name") & (F.col("votes") == F.array(*map(F.lit, BY_LIST)))
    voted = voted.filter(~by_list | (given + surname == 2))  # what only lists propose, both must know
    voted = voted.withColumn("votes", F.when(F.col("pii_type") == "name", votes).otherwise(F.col("votes"))).drop("w0", "w1")
    form = F.when(F.col("pii_type").isin("name", "email", "address"), F.lit("")).otherwise(F.col("shape"))
    voted = checkpoints.cut(voted.withColumn("shape", form))
    counts = voted.groupBy("pii_type", "votes", "shape").count().collect()  # at most 3^7 patterns by type and 240 forms
    accepted = []
    for kind in TYPES:
        rows = [(tuple(r["votes"]), r["shape"], r["count"]) for r in counts if r["pii_type"] == kind]
        if not rows:
            continue
        by_votes: dict[tuple[int, ...], int] = {}
        for v, _, n in rows:
            by_votes[v] = by_votes.get(v, 0) + n
        posterior = expectation_maximisation(sorted(by_votes.items()))
        accepted += [f"{kind}:{','.join(map(str, v))}:{s}" for (v, s), p in train(rows, posterior).items() if p > threshold]
    key = F.concat_ws(":", "pii_type", F.concat_ws(",", F.col("votes").cast("array<string>")), "shape")
    return voted.filter(key.isin(accepted) if accepted else F.lit(False))


def found_lines(texts: DataFrame, row_id: str, text: str, **options: float) -> DataFrame:
    """(row_id, pii_type, line_no) of the accepted spans."""
    return decided(texts, row_id, text, **options).select("row_id", "pii_type", "line_no").distinct()


def replaced(text: str, accepted: list[tuple[str, int, int]]) -> str:
    """A text with placeholders ``[TYPE]`` for spans (type, start, stop) of its view; characters outside stay as they are.

    Spans that overlap one before them are part of it.
    """
    _, at, places = _placed(text)
    lines = text.split("\n")
    edits: dict[int, list[tuple[int, int, str]]] = {}
    end = 0
    for kind, start, stop in sorted(accepted, key=lambda s: (s[1], -s[2])):
        if start < end:
            continue
        end = stop
        parts: dict[int, list[int]] = {}
        for n, place in zip(at[start:stop], places[start:stop], strict=True):
            if place >= 0:
                parts.setdefault(n, []).append(place)
        for k, (n, own) in enumerate(sorted(parts.items())):
            line, spans = traced(lines[n - 1])
            # an item that goes on in the next line takes the hyphen at the line's end with it
            last = len(line.rstrip()) - 1 if k + 1 < len(parts) else own[-1]
            edits.setdefault(n, []).append((spans[own[0]][0], spans[last][1], f"[{kind.upper()}]" if k == 0 else ""))
    for n, found in edits.items():
        for a, b, mark in sorted(found, reverse=True):
            lines[n - 1] = lines[n - 1][:a] + mark + lines[n - 1][b:]
    return "\n".join(lines)


def redact(texts: DataFrame, row_id: str, text: str, out: str, **options: float) -> DataFrame:
    """``texts`` with column ``out``: the text with typed placeholders; texts without spans are kept."""
    spots = decided(texts, row_id, text, **options).groupBy("row_id").agg(F.collect_set(F.struct("pii_type", "start", "stop")).alias("__spots")).withColumnRenamed("row_id", "__row_id")

    @F.pandas_udf("string")
    def put(values: pd.Series, spots: pd.Series) -> pd.Series:
        return pd.Series([v if v is None or s is None or not len(s) else replaced(v, [(x["pii_type"], x["start"], x["stop"]) for x in s]) for v, s in zip(values, spots, strict=True)])

    joined = texts.join(spots, F.col(row_id).cast("string") == F.col("__row_id"), "left")
    value: Column = F.when(F.col("__spots").isNull(), F.col(text)).otherwise(put(F.col(text), F.col("__spots")))
    return joined.withColumn(out, value).drop("__spots", "__row_id")
