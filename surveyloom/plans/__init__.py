"""Physical choices the operators share: scratch tables, skew splitting, global ranks."""
