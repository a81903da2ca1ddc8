"""Which encoding bytes are in, when nothing says so.

Encodings of several bytes a character are told by validity (a strict decoder is an automaton that refuses a text at its
first byte that can't be) and by what they decode to: wrong ones give rare characters. UTF-16 without a mark is
told by its order of bytes. Characters that mostly touch Latin letters are no East Asian ones. Pages of one byte a character are told by models of byte pairs: for each language and page, how often
pairs with a byte above 0x7F come in that language's words. Pages are compared over the same pairs of a text, so that
the sum of their logarithms says which one explains it best; each word counts once, and cp1252 has a start, which grows with the
words of A to Z alone, as its languages have most of those. Models are made from a short text of each language when first needed.

A text that decodes alike in several pages is right in each; cp1252 comes first. Texts of fewer than some ten words above
0x7F can be told wrongly; README has the figures for 200 bytes and more. Where few characters are of several bytes, a text of any
length is none in them.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: fixed values: the first article of the Universal Declaration of Human Rights, by language
SAMPLES = {
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Perché è così, più libertà.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Eén, geëerd, coördinatie.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Não são, ações, você.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Också på långa vägar.",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Її ґанок, є й життя.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
}
#: fixed values: letters above 0x7F of each language's alphabet
ALPHABETS = {
    "cs": "áčďéěíňóřšťúůýž", "da": "æøåé", "de": "äöüß", "es": "áéíñóúü¿¡", "fi": "äöå", "fr": "àâæçéèêëîïôœùûüÿ«»", "hu": "áéíóöőúüű", "it": "àèéìòù", "nl": "éëïóöü", "no": "æøåéò",
    "pl": "ąćęłńóśźż", "pt": "áâãàçéêíóôõúü", "ro": "ăâîşţ", "sv": "åäöé", "tr": "çğıöşüâîİ", "vi": "ăâđêôơự̀́̃̉", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ",
    "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "he": "אבגדהוזחטיכלמנסעפצקרשתךםןףץ", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئةى،؟",
    "th": "กขคงจฉชซญฐณดตถทธนบปผฝพฟภมยรลวศษสหอฮะาำิีึืุูเแโใไ่้็์ั",
}
LATIN = "éèêëáàâäåæçíîïñóôöøùúüß"  #: for languages that have such letters in borrowed words only
SIGNS = "“”‘’„–—…«»"  #: of all languages
#: fixed values: the pages of one byte a character that languages are written in, the usual one first
PAGES = {
    "cp1252": "de en es fr it nl pt sv da no fi id", "cp1250": "cs hu pl ro", "cp1251": "ru uk", "cp1253": "el", "cp1254": "tr", "cp1255": "he", "cp1256": "ar", "cp1258": "vi", "cp874": "th",
    "iso8859_2": "cs hu pl ro", "koi8_r": "ru", "koi8_u": "uk", "cp866": "ru", "iso8859_5": "ru", "iso8859_7": "el",
}
#: fixed values: encodings of several bytes a character, and the characters that texts in them mostly have
COMMON_CHINESE = "的一是不了在人有我他这個个们們中来來上大为為和国國地到以说說时時要就出会會可也你对對生能而子那得于着下自之年过過发發后後作里裡用道行所然家种種事成方多经經么麼去法学學如都同现現当當没沒动動面起看定天分还還进進好小部其些主样樣理心她本前开開但因只从從想实實"
WIDE = {"cp932": "ja", "euc_jp": "ja", "cp949": "ko", "gb18030": "zh", "cp950": "zh"}
SURE = {"ja": 0.35, "ko": 0.6, "zh": 0.15}  #: least share of such characters among those above 0x7F


USUAL = 40.0  #: fixed value: how far the usual page is ahead of others, as a logarithm; the difference that some ten words make
PLAIN = 0.3  #: fixed value: what a word of A to Z alone adds to that; where a quarter of all words have other letters, it makes such a difference
FEW = 8  #: fixed value: characters of several bytes, in words that count once, that a text of FEW * EACH bytes needs to be in them
EACH = 25  #: fixed value: bytes of a shorter text for each of them


def _wide_share(text: str, language: str) -> float:
    """The share of a text's characters above 0x7F that its language uses most."""
    high = [c for c in text if c > "\x7f" and not unicodedata.category(c).startswith(("P", "Z"))]
    usual = {"ja": lambda c: "ぁ" <= c <= "ヿ", "ko": lambda c: "가" <= c <= "힣", "zh": COMMON_CHINESE.__contains__}[language]
    return sum(map(usual, high)) / len(high) if high else 0.0


def in_page(text: str, page: str) -> bytes:
    """A text in a page of one byte a character, as files have it: for Vietnamese with tones as marks of their own; what the page lacks is left out."""
    if page == "cp1258":
        tones = "̣̀́̃̉"
        parts = []
        for c in unicodedata.normalize("NFC", text):
            marks = [m for m in unicodedata.normalize("NFD", c) if m in tones]
            base = unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFD", c) if m not in tones))
            parts.append(base + "".join(marks))
        text = "".join(parts)
    if page in ("cp1250", "iso8859_2"):
        text = text.translate(str.maketrans("șțȘȚ", "şţŞŢ"))
    return text.encode(page, "ignore")


@cache
def _small(page: str) -> np.ndarray:
    """Each byte of a page as that of its small letter."""
    out = np.arange(256)
    for b in range(256):
        small = bytes([b]).decode(page, "replace").lower().encode(page, "ignore")
        out[b] = small[0] if len(small) == 1 else b
    return out


@cache
def models(page: str) -> np.ndarray:
    """(languages, 256, 256): the logarithm of how often a pair of bytes comes in each language of a page."""
    tables = []
    for language in PAGES[page].split():
        small = _small(page)
        data = small[np.frombuffer(in_page(f" {SAMPLES[language]} ", page), np.uint8)]
        pairs = np.zeros((256, 256))
        np.add.at(pairs, (data[:-1], data[1:]), 1)
        single = np.bincount(data, minlength=256) + 0.0
        letters = small[np.frombuffer(in_page(ALPHABETS.get(language, LATIN) + SIGNS, page), np.uint8)]
        single[letters] += 0.5
        single /= single.sum()
        tables.append(np.log(0.5 * pairs / pairs.sum() + 0.5 * np.outer(single, single) + 1e-9))
    return np.stack(tables)


def _explained(data: np.ndarray, page: str) -> float:
    """The logarithm of how well a page explains a text's pairs with a byte above 0x7F, in its best language."""
    first, second = data[:-1], data[1:]
    high = (first > 0x7F) | (second > 0x7F)
    small = _small(page)
    return float(models(page)[:, small[first[high]], small[second[high]]].sum(axis=1).max())


def _sixteen(data: bytes) -> str | None:
    """utf-16-le or utf-16-be, if bytes without a mark look like it: one byte of each two is mostly a control (0 for Latin letters) or the same, or the characters are those of one script of many letters."""
    if len(data) < 4 or len(data) % 2:
        return None
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    control = [_IS_CONTROL[pairs[:, i]].mean() for i in (0, 1)]
    for name, high in (("utf-16-le", 1), ("utf-16-be", 0)):
        if control[high] >= 0.5 and control[high] > 2 * control[1 - high] and _valid(data, name):
            return name
    if 32 * (data.count(b" ") - data.count(b"\0")) > len(data):  # words between spaces, which have a 0 each in UTF-16
        return None
    top = [np.bincount(pairs[:, i]).max() / len(pairs) for i in (0, 1)]
    for name, high in sorted((("utf-16-le", 1), ("utf-16-be", 0)), key=lambda x: -top[x[1]]):
        if _valid(data, name):
            text = data.decode(name)
            odd = sum(unicodedata.category(c) in ("Cn", "Co", "Cc") and c not in "\t\r\n" for c in text)
            one = top[high] >= 0.5 and top[high] > 2 * top[1 - high]
            if 100 * odd <= len(text) and (one or any(_wide_share(text, language) >= least for language, least in SURE.items())):
                return name
    return None


_CONTROLS = rb"[\x00-\x08\x0E-\x1F]"  # no text of one byte a character has many of them
_IS_CONTROL = np.array([bool(re.fullmatch(_CONTROLS, bytes([b]))) for b in range(256)])


def _marked(data: bytes) -> bytes:
    """The words with a byte above 0x7F, each once: words that are said again and again tell no more than once."""
    return b" " + b" ".join(dict.fromkeys(w for w in data.split() if not w.isascii())) + b" "


def _in_words(text: str) -> bool:
    """Whether most characters above 0x7F touch a letter of A to Z, as those of Latin alphabets do."""
    high = len(re.findall(r"[^\x00-\x7F]", text))
    return 2 * len(re.findall(r"(?<=[A-Za-z])[^\x00-\x7F]|[^\x00-\x7F](?=[A-Za-z])", text)) > high


def _wide(data: bytes) -> str | None:
    """The encoding of several bytes a character that is valid and gives mostly usual characters of its language, in words of their own."""
    marked, least = _marked(data), min(FEW, len(data) // EACH)
    texts = {name: marked.decode(name) for name in WIDE if _valid(data, name) and _valid(marked, name)}
    shares = {name: _wide_share(text, WIDE[name]) / SURE[WIDE[name]] for name, text in texts.items() if not _in_words(text) and sum(c > "\x7f" for c in text) >= least}
    best = max(shares, key=shares.get, default=None)
    return best if best and shares[best] >= 1 else None


def detect(data: bytes) -> str:
    """The name of the encoding of some bytes; latin-1 where nothing else can be."""
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    controls = re.search(_CONTROLS, data)
    found = (_sixteen(data) if controls else None) or ("utf-8-sig" if _valid(data, "utf-8") else None) or _wide(data) or (None if controls else _sixteen(data))
    if found:
        return found
    codes, start = np.frombuffer(_marked(data), np.uint8), USUAL + PLAIN * len({w for w in data.split() if w.isalpha()})
    pages = {name: _explained(codes, name) + (start if name == "cp1252" else 0.0) for name in PAGES if _valid(data, name)}
    return max(pages, key=pages.get, default="latin-1")


def _valid(data: bytes, name: str) -> bool:
    try:
        data.decode(name)
    except UnicodeDecodeError:
        return False
    return True


@pandas_udf(StringType())
def _decoded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes that are no UTF-8 without controls, each with the page to try first."""
    for data, page in parts:
        yield pd.Series([None if d is None else _by(d, p) for d, p in zip(data, page, strict=True)], dtype=object)


def _by(data: bytes, page: str | None) -> str:
    if not data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) and page and _valid(data, page):
        return data.decode(page)
    return data.decode(detect(data), "replace")


#: fixed values: code pages of languages; others take 1252
CODE_PAGES = {"cs": "cp1250", "hu": "cp1250", "pl": "cp1250", "ro": "cp1250", "ru": "cp1251", "uk": "cp1251", "el": "cp1253", "tr": "cp1254", "he": "cp1255", "ar": "cp1256", "vi": "cp1258"}


def decode_text(data: Column, language: Column) -> Column:
    """Bytes of a file as text: by its mark, else as UTF-8, else by its language's code page if there is a language, else by detect.

    UTF-8 is decoded by Spark; only other bytes, and those with controls, which may be UTF-16, are looked at in Python. Null for null; a mark
    is left out.
    """
    base = F.lower(F.get(F.split(language, "-"), F.lit(0)))
    page = F.when(language.isNotNull(), F.coalesce(*(F.when(base == k, v) for k, v in CODE_PAGES.items()), F.lit("cp1252")))
    plain = F.is_valid_utf8(data.cast("string")) & ~F.rlike(data.cast("string"), F.lit(_CONTROLS.decode()))
    return F.when(plain, F.regexp_replace(data.cast("string"), r"\A\x{FEFF}", "")).otherwise(_decoded(F.when(~plain, data), page))
