import pytest
from pyspark.sql import functions as F

from codeloom.llm.lexing import real_language
from codeloom.llm.natural import Classifier, in_files, in_symbols, runs_of, texts_of

# Sentences that are not in the samples.
SENTENCES = {
    "en": ["The cache is dropped as soon as the window closes", "Keys are compared without their prefix"], "de": ["Der Zwischenspeicher wird beim Schließen des Fensters geleert", "Ohne diese Zeile bleibt der alte Stand bestehen"],
    "fr": ["Le cache est vidé dès que la fenêtre se ferme", "Sans cette ligne l'ancien état reste en place"], "es": ["La memoria se vacía en cuanto se cierra la ventana", "Sin esta línea queda el estado anterior"],
    "pt": ["A memória é limpa assim que a janela se fecha", "Sem esta linha o estado antigo continua"], "it": ["La memoria viene svuotata appena si chiude la finestra", "Senza questa riga resta lo stato precedente"],
    "nl": ["Het geheugen wordt geleegd zodra het venster sluit", "Zonder deze regel blijft de oude toestand staan"], "ru": ["Память очищается сразу после закрытия окна"], "ja": ["ウィンドウを閉じるとすぐに消去されます"], "zh": ["关闭窗口以后就会立刻清空缓存"],
}


@pytest.mark.parametrize(("want", "text"), [(k, t) for k, ts in SENTENCES.items() for t in ts])
def test_languages_of_new_sentences(want, text):
    assert Classifier()(runs_of(f"// {text}.", True)) == [want]


@pytest.mark.parametrize("text", ["// noqa: E501", "// return total + 4;", "// x = y + 1", "/** @param depth\n * @return */", "// keep order\n// hot loop\n// fast path", "// eslint-disable-next-line no-shadow", "// weights: 1 2 3 4 5", "// see caller", "// qzx wvkj xqpz kkjh", "", "/** */"])
def test_no_language(text):
    assert [x for x in Classifier()(runs_of(text, True)) if x] == []


OTHERS = [
    "Vi måste ladda tabellen två gånger eftersom storleken var okänd", "Servern svarar inte och därför försöker vi igen efter en stund", "Musimy wczytać tabelę dwa razy, ponieważ rozmiar był nieznany", "Serwer nie odpowiada, dlatego próbujemy ponownie po chwili",
    "Moramo dvaput učitati tablicu jer veličina nije bila poznata", "Poslužitelj ne odgovara pa pokušavamo ponovno nakon nekog vremena", "Ми мусимо двічі завантажити таблицю, бо розмір був невідомий", "Сервер не відповідає, тому ми спробуємо ще раз трохи згодом",
    "Трябва да заредим таблицата два пъти, защото размерът беше неизвестен", "Сървърът не отговаря и затова опитваме отново след малко", "Musíme načíst tabulku dvakrát, protože velikost nebyla známá", "Trebuie să încărcăm tabelul de două ori pentru că mărimea era necunoscută",
]
KNOWN = {"ru": "Сервер не отвечает, поэтому мы попробуем ещё раз немного позже", "zh": "服务器没有回答所以我们稍后再试一次", "ja": "サーバーが応答しないので少し後でもう一度試します", "en": "The server does not answer, so we try again after a while", "de": "Der Server antwortet nicht, darum versuchen wir es später noch einmal", "nl": "De server antwoordt niet en daarom proberen we het later opnieuw", "es": "El servidor no responde y por eso lo intentamos otra vez más tarde"}


@pytest.mark.parametrize("text", OTHERS)
def test_other_languages_are_rejected(text):
    assert Classifier()(runs_of(f"// {text}.", True)) in ([None], [])


@pytest.mark.parametrize("want", KNOWN)
def test_known_languages_are_kept(want):
    assert Classifier()(runs_of(f"// {KNOWN[want]}.", True)) == [want]


def test_comments_merge_and_strings_count():
    body = 'fn a() {\n    // This sentence is so long that it goes on\n    // in the line after it.\n    print("Nothing is left to do here.");\n    print("index/rebuild");\n}\n'
    runs = [r for c, t in texts_of(body, "rust") for r in runs_of(t, c)]
    assert runs == ["This sentence is so long that it goes on in the line after it", "Nothing is left to do here"]


def test_texts_in_another_language_use_their_own_comments():
    py = "import os\nfrom a import b\n\ndef f(self):\n    # Der Wert bleibt bis zum Ende stehen.\n    return 1\n\nclass A:\n    pass\n"
    assert real_language(py, "java") == "python" and real_language(py, None) == "python"
    assert [r for c, t in texts_of(py, "java") for r in runs_of(t, c)] == ["Der Wert bleibt bis zum Ende stehen"]


def test_tables(spark):
    b = "// The value is kept until the end.\n// Der Wert bleibt bis zum Ende stehen.\nfn a() {}\n"
    s = spark.createDataFrame([("a.rs", b), ("a.rs", b), ("b.rs", None), ("c.rs", ""), (None, b), ("d.rs", "// The value is kept until the end. " * 5000)], "path string, body string").withColumn("key", F.lit(1))
    f = spark.createDataFrame([], "path string, language string, indexed_at int")
    assert sorted((r.path, r.nl_lang) for r in in_files(s, f).collect()) == [("a.rs", "de"), ("a.rs", "en"), ("d.rs", "en")]
    y = spark.createDataFrame([("1", 1, "/** Ein alter Text, der nicht mehr gilt. */"), ("1", 2, "/// The value is kept until the end.\n/// It is not changed by anything else.\n/// Der Wert bleibt."), ("2", 1, None), ("3", 1, "TODO"), (None, 1, "The value is kept until the end.")], "id string, indexed_at int, doc_comment string")
    assert [(r.symbol_id, r.nl_lang) for r in in_symbols(y).collect()] == [("1", "en")]
    assert in_files(s.limit(0), f).count() == 0 and in_symbols(y.limit(0)).count() == 0
