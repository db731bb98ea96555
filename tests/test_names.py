"""Hints of field names, by hand."""

from assaykit.functions import names


def told(name):
    return {(h.family, h.type, h.strength, h.supports) for h in names.hints(name)}


def test_words():
    assert names.words("customerID") == "customer id" and names.words("HTTPServer_url") == "http server url" and names.words("Prénom 2") == "prenom 2" and names.words("__") == ""


def test_hints():
    assert told("id") == {("identifier", "id", "exact", True)}
    assert told("CustomerId") == {("identifier", "id", "sequence", True)}
    assert told("valid") == set() and told("") == set()
    assert told("email_status") == {("contact", "email", "token", False)}
    assert told("work_email") == {("contact", "email", "affix", True)}
    assert told("customer_id_length") == {("identifier", "id", "sequence", False)}
    assert told("birth_year") == {("temporal", t, "token", False) for t in ("date", "datetime", "time")}
    assert told("sex") == {("categorical", "enum", "exact", True), ("categorical", "boolean", "exact", False)}
    assert told("is_active_flag") == {("categorical", "boolean", "affix", True)}
    assert told("created_at") == {("temporal", "datetime", "exact", True)}
    assert told("delivery_zip_code") == {("geographic", "postal_code", "sequence", True)}
    assert told("discount_pct") == {("numeric", "percentage", "sequence", True)}


def test_choice():
    both = [("geographic", "postal_code"), ("numeric", "integer")]
    assert names.chosen(both, "zip") == both[:1] and names.chosen(both, "n") == both and names.chosen([("temporal", "date")], "birth_year") == [("temporal", "date")]
