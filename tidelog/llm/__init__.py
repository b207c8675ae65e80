"""Training-data operators: ten document operators and the pipeline that chains five of them."""
