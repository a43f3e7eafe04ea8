"""Honorifics before names, in texts whose words hold both."""

from quire.operators import entities


def test_honours_are_words_of_their_own():
    # "que" inside "queen" is no mention, and "queen" inside another word no honorific
    assert entities.context_score("Que", "êtion queen que èççè") == 1
    assert entities.context_score("Eux", "uneneuxqueen eux enanle") == 0
