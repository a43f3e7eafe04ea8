import random

import pytest

from helpers import frame, prose
from quire.llm.pii import FEATURES, KINDS, personal_data, planted, weak


@pytest.mark.parametrize("every", [400, 20, 2])
def test_cued_numbers_and_obfuscated_mails_get_spans_at_any_share(spark, every):
    r = random.Random(every)
    texts, want = [], {}
    for i in range(800):
        text = prose(i, 12) + f" order {r.randrange(10**9, 10**10)} of 2024-01-02 and +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} mail u{i}@h.example.org end"
        if i % every in (0, 1):
            phone, mail = f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", f"bob{i} (at) example.com"
            head = text + " phone: "
            text = head + phone + " ok " + "x " * 20 + mail + " end"
            want[i] = {(len(head), 3, len(head) + len(phone)), (text.index(mail), 0, text.index(mail) + len(mail))}
        texts.append(text)
    got = {x.doc_id: {tuple(s) for s in x.spans} for x in personal_data(frame(spark, texts)).collect()}
    assert all(spans <= got[i] for i, spans in want.items())
    plain = [s for i, spans in got.items() for s in spans if s[1] == 3 and texts[i][: s[0]].endswith("order ")]
    assert not plain  # bare numbers without a cue


def test_labels_are_not_the_base_rule():
    bit = {n: 1 << i for i, n in enumerate(FEATURES)}
    phone, mail = KINDS.index("phone") << len(FEATURES), KINDS.index("email") << len(FEATURES)
    assert weak(phone | bit["cue"] | bit["checks"] | bit["length_fits"]) and not weak(phone | bit["checks"] | bit["length_fits"])
    assert weak(mail | bit["brackets"] | bit["length_fits"])
    assert planted(phone | bit["plus"] | bit["cue"]) == phone | bit["cue"]
