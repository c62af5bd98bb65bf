"""Stream definitions and the plans made from them."""
