"""Detection of encodings, on texts that the models were not made from."""

import codecs

import pytest
from pyspark.sql import functions as F

from loomspan.functions.charset import PAGES, decode_text, detect, in_page

#: other texts of some 200 bytes and more
TEXTS = {
    "ar": "كان الجو جميلا اليوم وذهبنا إلى السوق لشراء الخبز والفاكهة. قال لي صديقي إن المدينة القديمة مليئة بالحكايات. عدنا إلى البيت قبل غروب الشمس وشربنا الشاي معا ثم قرأت كتابا عن البحر.",
    "cs": "Dnes ráno jsme šli na trh koupit čerstvý chléb a třešně. Můj přítel řekl, že staré město je plné příběhů. Večer jsme seděli u řeky, pili čaj a dívali se na světla lodí. Zítra pojedeme vlakem do hor.",
    "da": "I dag gik vi på markedet for at købe brød og æbler. Min ven sagde, at den gamle by er fuld af historier. Om aftenen sad vi ved åen, drak te og så på bådenes lys. I morgen kører vi ud til søen.",
    "de": "Heute gingen wir über den Markt, um Brot und Äpfel zu kaufen. Mein Freund erzählte, dass die alte Stadt voller Geschichten sei. Abends saßen wir am Fluss, tranken Tee und hörten den Vögeln zu. Morgen fährt der Zug früh.",
    "el": "Σήμερα πήγαμε στην αγορά για να πάρουμε ψωμί και μήλα. Ο φίλος μου είπε ότι η παλιά πόλη είναι γεμάτη ιστορίες. Το βράδυ καθίσαμε δίπλα στο ποτάμι και ήπιαμε τσάι. Αύριο θα πάμε στο βουνό με το τρένο.",
    "en": "Today we went to the market to buy bread and apples at the “old café”. My friend said that the old town is full of stories. In the evening we sat by the river, drank tea and watched the boats. That’s what we’ll do again.",
    "es": "Hoy fuimos al mercado a comprar pan y manzanas. Mi amigo me contó que la ciudad está llena de historias. ¿Quién sabe? Por la tarde nos sentamos junto al río, tomamos té y miramos los barcos. Mañana iremos a la montaña con los niños.",
    "fi": "Tänään kävimme torilla ostamassa leipää ja omenoita. Ystäväni kertoi, että vanha kaupunki on täynnä tarinoita. Illalla istuimme joen rannalla, joimme teetä ja katselimme veneitä. Huomenna lähdemme junalla pohjoiseen.",
    "fr": "Aujourd’hui nous sommes allés au marché pour acheter du pain et des pommes. Mon frère a dit que la vieille ville était pleine d’histoires. Le soir, assis près de la rivière, nous avons bu du thé à côté d’un château. Où étiez-vous, ça va?",
    "he": "היום הלכנו לשוק לקנות לחם ותפוחים. החבר שלי אמר שהעיר העתיקה מלאה סיפורים. בערב ישבנו ליד הנהר, שתינו תה והסתכלנו על הסירות. מחר ניסע ברכבת אל ההרים ונחזור רק אחרי השבת.",
    "hu": "Ma reggel elmentünk a piacra, hogy kenyeret és almát vegyünk. A barátom azt mondta, hogy az öreg város tele van történetekkel. Este a folyó mellett ültünk, teát ittunk és néztük a hajókat. Holnap vonattal megyünk a hegyekbe, ahol hűvös erdő vár.",
    "id": "Hari ini kami pergi ke pasar untuk membeli roti dan apel di “Café Baru”. Teman saya berkata bahwa kota tua itu penuh cerita. Malam harinya kami duduk di tepi sungai, minum teh dan melihat perahu. Besok kami naik kereta – pagi sekali.",
    "it": "Oggi siamo andati al mercato perché volevamo comprare pane e mele. Il mio amico ha detto che la città vecchia è piena di storie. La sera, seduti lungo il fiume, abbiamo bevuto tè e caffè. Domani andrò in montagna, così vedrò la neve più bella.",
    "nl": "Vandaag gingen we naar de markt om brood en appels te kopen. Mijn vriend zei dat de oude stad vol verhalen zit. Hij heeft één zoon, Daniël, en twee ideeën. ’s Avonds zaten we bij de rivier, dronken thee en keken naar de bootjes. Morgen gaan we naar België.",
    "no": "I dag gikk vi på torget for å kjøpe brød og epler. Vennen min sa at den gamle byen er full av historier. Om kvelden satt vi ved elva, drakk te og så på båtene. I morgen drar vi til fjells med toget, så får vi se snø.",
    "pl": "Dziś poszliśmy na targ, żeby kupić chleb i jabłka. Mój przyjaciel powiedział, że stare miasto jest pełne opowieści. Wieczorem siedzieliśmy nad rzeką, piliśmy herbatę i patrzyliśmy na łodzie. Jutro pojedziemy pociągiem w góry, gdzie leży śnieg.",
    "pt": "Hoje fomos ao mercado comprar pão e maçãs. O meu irmão disse que a cidade antiga está cheia de histórias. À noite sentámo-nos junto ao rio, bebemos chá e vimos as embarcações. Amanhã vamos à montanha, se não chover; as crianças também irão.",
    "ro": "Astăzi am mers la piață să cumpărăm pâine și mere. Prietenul meu a spus că orașul vechi este plin de povești. Seara am stat lângă râu, am băut ceai și ne-am uitat la bărci. Mâine vom pleca la munte cu trenul, dacă nu va ninge în toată țara.",
    "ru": "Сегодня мы ходили на рынок за хлебом и яблоками. Мой друг сказал, что старый город полон историй. Вечером мы сидели у реки, пили чай и смотрели на лодки. Завтра поедем на поезде в горы, где уже лежит снег.",
    "sv": "I dag gick vi till torget för att köpa bröd och äpplen. Min vän sade att den gamla staden är full av berättelser. På kvällen satt vi vid ån, drack te och såg på båtarna. I morgon åker vi till fjällen med tåget, så får vi se snö.",
    "th": "วันนี้เราไปตลาดเพื่อซื้อขนมปังและแอปเปิล เพื่อนของฉันบอกว่าเมืองเก่าเต็มไปด้วยเรื่องราว ตอนเย็นเรานั่งริมแม่น้ำ ดื่มชาและมองดูเรือ พรุ่งนี้เราจะนั่งรถไฟไปภูเขา",
    "tr": "Bugün ekmek ve elma almak için çarşıya gittik. Arkadaşım eski şehrin hikâyelerle dolu olduğunu söyledi. Akşam ırmağın kıyısında oturduk, çay içtik ve gemilere baktık. Yarın trenle dağlara gideceğiz, çünkü orada kış çoktan başladı.",
    "uk": "Сьогодні ми ходили на ринок по хліб і яблука. Мій друг сказав, що старе місто сповнене історій. Увечері ми сиділи біля річки, пили чай і дивилися на човни. Завтра поїдемо потягом у гори, де вже лежить сніг.",
    "vi": "Hôm nay chúng tôi đi chợ để mua bánh mì và táo. Bạn tôi nói rằng thành phố cổ có rất nhiều câu chuyện. Buổi tối chúng tôi ngồi bên bờ sông, uống trà và ngắm những con thuyền. Ngày mai chúng tôi sẽ đi tàu hỏa lên núi.",
    "ja": "今日は友だちと市場へ行って、パンとりんごを買いました。古い町には多くの物語があると友だちは言いました。夕方は川のそばにすわってお茶を飲み、船をながめました。あしたは電車で山へ行くつもりです。",
    "ko": "오늘 우리는 빵과 사과를 사러 시장에 갔다. 친구는 오래된 도시가 이야기로 가득하다고 말했다. 저녁에는 강가에 앉아 차를 마시며 배를 바라보았다. 내일은 기차를 타고 산으로 갈 것이다.",
    "zh": "今天我们去市场买面包和苹果。我的朋友说,这个老城有很多故事。晚上我们坐在河边,一边喝茶一边看船。明天我们要坐火车去山里,因为那里已经下雪了。我想他会和我们一起去的。",
    "hi": "आज हम रोटी और सेब खरीदने बाज़ार गए। मेरे मित्र ने कहा कि पुराना शहर कहानियों से भरा है। शाम को हम नदी के किनारे बैठे, चाय पी और नावों को देखते रहे।",
}
TRADITIONAL = "今天我們去市場買麵包和蘋果。我的朋友說,這個老城有很多故事。晚上我們坐在河邊,一邊喝茶一邊看船。明天我們要坐火車去山裡,因為那裡已經下雪了。我想他會和我們一起去的。"
USUAL = [(language, page) for page, of in PAGES.items() for language in of.split()] + [("ja", "cp932"), ("ja", "euc_jp"), ("ko", "cp949"), ("zh", "gb18030"), ("zh-tw", "cp950")]
USUAL += [(language, name) for language in TEXTS for name in ("utf-8", "utf-16-le", "utf-16-be", "utf-16")]


def encoded(language, page):
    text = TRADITIONAL if language == "zh-tw" else TEXTS[language]
    return in_page(text, page) if page in PAGES else text.encode(page)


@pytest.mark.parametrize("language, page", USUAL)
def test_each_language_in_its_usual_encodings(language, page):
    data = encoded(language, page)
    assert len(data) >= 150
    assert data.decode(detect(data)) == data.decode(page), detect(data)


def test_subtitles_with_times_and_capitals():
    for language in ("ru", "el", "cs", "tr", "ar", "he", "th"):
        page = next(p for p, of in PAGES.items() if language in of.split())
        blocks = [f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{line.upper() if i % 3 == 0 else line}\n" for i, line in enumerate(TEXTS[language].split(". "))]
        data = in_page("\n".join(blocks), page)
        assert data.decode(detect(data)) == data.decode(page), language


def test_as_a_column(spark):
    rows = [(i, encoded(language, page), None if i % 2 else language.split("-")[0]) for i, (language, page) in enumerate(USUAL) if page not in ("iso8859_2", "koi8_r", "koi8_u", "cp866", "iso8859_5", "iso8859_7", "cp874") and not page.startswith("utf-16-") or i % 2]
    rows += [(1000, None, "en"), (1001, b"", None), (1002, codecs.BOM_UTF8 + b"marked", "en"), (1003, b"\x81\xff\xfe\x00", None), (1004, b"plain", None)]
    want = {}
    for i, data, language in rows:
        if i < 1000:
            want[i] = data.decode(USUAL[i][1])
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, data binary, language string").select("i", decode_text(F.col("data"), F.col("language")).alias("t")).collect()}
    for i, text in want.items():
        language = next(r[2] for r in rows if r[0] == i)
        if language in (None, "de", "en", "es", "fr", "it", "nl", "pt", "sv", "da", "no", "fi", "id", "cs", "ru", "el") or USUAL[i][1].startswith("utf"):
            assert got[i] == text, USUAL[i]
    assert got[1000] is None and got[1001] == "" and got[1002] == "marked" and got[1004] == "plain" and got[1003] is not None
