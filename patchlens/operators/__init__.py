"""DataFrame operators: rules, findings algebra, scores, reports, commands, quality."""
