"""Reading and writing recordings, tensors, splits and results."""
