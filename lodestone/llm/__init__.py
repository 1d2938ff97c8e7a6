"""Training-data operators: each module is one operator, ``queries`` registers them."""
