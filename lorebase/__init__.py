"""Analytics over a store of text knowledge, as DataFrame operators."""
