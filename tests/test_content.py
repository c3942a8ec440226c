from collections import Counter

from papyra.sources.corpus import table
from papyra.plans import content


def test_restated_overlap_counts_whole_texts(spark, sf_dir):
    letters = lambda t: Counter(c for c in (t or "").lower() if c.isascii() and c.isalnum())
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    plain = {i for i, t in items.items() if t.isascii() and (docs.get(i) or "").isascii()}
    found = {r.item_id: r for r in content.restated_overlap(spark, sf_dir).collect()}
    checked = [i for i in plain if i in found]
    assert checked
    for i in checked:
        assert found[i].n_shared == sum((letters(items[i]) & letters(docs[i])).values())
