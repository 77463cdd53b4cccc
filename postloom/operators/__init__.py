"""DataFrame operators: decode, posts, activity, vectors and clusters."""
