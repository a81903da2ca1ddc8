"""Latin-1 texts with few or odd words above 0x7F."""

import pytest

from loomspan.functions.charset import detect

PLAIN = "Of thedndtion ingingha ertion it that thenin edouin than onorat anth, onerth. " * 4


@pytest.mark.parametrize("words", ["Äau " * 72, "Èçai enèémentier treètion " * 14, "SCHÄIE!! ÄSCH!!", "ñjamente ñboó", "óí. ñó " * 174, "üß " * 29, "èçè aiéè.", "éç, éèç enêè élementvi " * 148, "Ueñ ñjamirr ñrrga, ñja ñramici.", "èê,"])
def test_words_that_other_encodings_could_explain(words):
    data = f"{PLAIN}{words} {PLAIN}".encode("latin-1")
    assert data.decode(detect(data)) == data.decode("latin-1"), detect(data)
