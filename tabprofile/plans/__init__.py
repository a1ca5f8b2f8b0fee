"""Task descriptions, suggested steps, preprocessing, training and explanation."""
