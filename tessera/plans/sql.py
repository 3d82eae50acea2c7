"""SQL that several oracles share."""

GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"
