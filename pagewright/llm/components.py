"""Components, as the training-data operators use them."""

from pagewright.operators.components import components, roots_of  # noqa: F401
