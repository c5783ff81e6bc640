import random
import re

from tidemill.llm import licenses


def test_phrases_of_one_word_and_inside_others(spark):
    phrases = (("x", "foo"), ("y", "foo bar"), ("z", "bar foo bar baz"))
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["foo", "Bar", "baz", "qux", "--"]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, phrases=phrases).collect()}
    for d, text in rows:
        words = re.findall("[a-z]+", text.lower())
        places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert got[d].n_base == len(places) and got[d].base_labels == ",".join(sorted({x for _, x in places}))
        assert (got[d].first_word, got[d].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
