"""Column functions: arrays of measurements, numbers and labels in text, test statistics."""
