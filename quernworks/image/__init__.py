"""Image kernels in numpy and the Arrow functions around them."""
